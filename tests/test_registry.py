"""Queries beside their SQL at the smallest scale, and the shape of plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, table

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "conditions_daily_p2_j1", "medications_daily_j2_p4", "measurements_daily_w1_p5_j3", "concept_counts_a1",
    "demographics_metadata_p8_f5_h9", "index_fitted_p15", "range_join_j15", "asof_latest_j10",
    "match_forward_j11", "event_intensity_small_bins_t3", "binary_signal_carried_w4", "stats_pooled_a15",
    "dense_matrix_m1", "covariance_a23", "auc_by_language_a24", "contiguous_parts_o10",
    "impact_f13", "scaler_background_m3_m6", "contiguous_parts_text_o10", "sequence_interpolated_t16",
    "auc_replicates_a24", "best_partners_columns_l8_l10_o11", "whitening_reconstructs_l1_o3", "ica_step_l4_l5",
    "threshold_grid_100_a20", "projected_matrix_t15_m2", "curves_365_t7_w2",
    "leading_components_l1_o3", "keyed_stats_a26_m8", "curves_stored_s16_s17_j9", "asof_stored_j9_j10",
    "projection_stored_j9_t15", "compressed_curves_t9", "data_checks_t6_s7", "conformed_events_s6", "differing_rows_p11",
    "data_older_rule_h11", "metadata_older_rule_h11", "shortened_names_f12", "sources_mixed_back_l3_l6",
    "measurements_p5_p6", "visits_p7", "cross_section_t10_j13",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    assert mine == table([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", [
    "medications_daily_j2_p4", "select_data_j6_o1", "asof_latest_j10", "curves_t7",
    "projection_points_t15", "assembled_matrix_m2_m5_m6",
])
def test_plans_hold_no_pairwise_join_and_no_one_task_window(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in plan.split("\n"):
        assert not ("SinglePartition" in line and "ENSURE_REQUIREMENTS" in line), line


def test_range_join_forms_no_pairs(spark):
    df = entry.queries()["range_join_j15"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_small_dimensions_are_broadcast_from_the_start(spark):
    df = entry.queries()["select_data_j6_o1"](spark, FOLDER)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["projection_points_t15", "assembled_matrix_m2_m5_m6"])
def test_generated_code_compiles(spark, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        entry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_filters_and_columns_reach_the_scan(spark):
    df = entry.queries()["conditions_p1_a8"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan
