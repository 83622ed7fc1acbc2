import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from longspan.operators import curves as U
from longspan.operators import projection as P
from longspan.operators import space as S
from longspan.schema import EHR
from longspan.sources.stored import by_person, create_schema_at, drop_stored, store

OPTIONS = U.CurveOptions.windowed(7)


def events(spark):
    start = dt.datetime(2024, 1, 1, 8)
    rows = [(p, 10 + (i + p) % 3, start + dt.timedelta(hours=7 * i), float(i % 5))
            for p in range(12) for i in range(40 if p else 400)]  # person 0 is hot
    return spark.createDataFrame(rows, EHR)


def meta(spark):
    return spark.createDataFrame([(10, "Condition"), (11, "Measurement"), (12, "Medication")],
                                 "concept_id long, data_mode string")


@pytest.fixture()
def stored(spark, tmp_path):
    schema = f"kept_{uuid.uuid4().hex[:8]}"
    create_schema_at(spark, schema, str(tmp_path / "schema"))
    create_schema_at(spark, schema, str(tmp_path / "schema"))  # a second time changes nothing
    name = f"{schema}.daily"
    yield lambda df, part=0: store(df, name, 4, str(tmp_path / f"t{part}"))
    drop_stored(spark, name)
    assert not spark.catalog.tableExists(name)


def exchanges(df):
    """Exchanges of rows between tasks in the plan before it adapts; broadcasts do not count."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_a_stored_table_is_replaced_by_a_result_that_reads_it(spark, stored):
    first = stored(U.daily_events(events(spark)))
    wanted = first.count()
    second = stored(first.where("person_id > 0"), 1)
    assert 0 < second.count() < wanted
    assert second.where("person_id = 0").count() == 0


def test_person_joins_windows_and_sums_of_stored_tables_move_nothing(spark, stored):
    daily = stored(U.daily_events(events(spark)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = U.day_grid(daily)
        assert exchanges(daily.join(grid, "person_id")) == []
        plain = U.daily_events(events(spark))
        assert len(exchanges(plain.join(U.day_grid(plain), "person_id"))) >= 2
        # A table kept by the same function is placed alike.
        space = by_person(4)(S.sample_space(events(spark)))
        assert exchanges(daily.join(space, "person_id")) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_curves_of_stored_rows_move_nothing_where_the_engine_may_place_by_person(spark, stored):
    daily = stored(U.daily_events(events(spark)))
    # The concept dimension has a known size in production; here it is named as small.
    curves = U.curves_of_daily(daily, F.broadcast(meta(spark)), options=OPTIONS)
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert exchanges(curves) == []
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_results_do_not_depend_on_how_tables_are_kept(spark):
    data = events(spark)
    plain = U.build_curves(data, meta(spark), options=OPTIONS)
    kept = U.build_curves(data, meta(spark), options=OPTIONS, keep=by_person(3))
    same = lambda df: sorted((r.person_id, r.concept_id, r.day, round(r.value, 9)) for r in df.collect())
    assert same(plain) == same(kept)


def test_null_persons_and_empty_tables_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 2)], "person_id long, concept_id long")
    assert by_person(3)(df).count() == 3
    assert by_person(3)(df.limit(0)).count() == 0
    assert by_person(3)(df).columns == ["person_id", "concept_id"]


def test_spark_knows_the_size_of_stored_rows(spark, stored):
    """Equal days shrink to nothing in a file; their joins must not be taken for small ones."""
    rows = spark.range(60_000).select(
        (F.col("id") % 10).alias("person_id"), F.lit(1).cast("long").alias("concept_id"), F.lit(1.0).alias("value"))
    kept = stored(rows)
    assert kept.count() == 60_000
    assert int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 60_000 * 20


def test_projection_looks_up_written_rows_only(spark, tmp_path):
    """Persons, modes and daily rows are written once: no look-up reads the events or deals rows by a few concepts."""
    folder = str(tmp_path / "events")
    events(spark).write.parquet(folder)
    ehr = spark.read.parquet(folder)
    index = ehr.select("person_id", F.expr("datetime + interval 1 day").alias("datetime"))
    found = P.project_points(index, ehr, meta(spark), OPTIONS, by_person(3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in found.inputFiles() if folder in f]
    assert "hashpartitioning(concept_id" not in plan
    assert found.count() > 0
