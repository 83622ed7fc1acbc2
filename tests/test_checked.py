"""Checks counted in the pass of the result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from longspan.operators import checked as K
from longspan.operators import curves as U
from longspan.schema import EHR, VISITS

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(5)]
DAILY = "person_id long, concept_id long, day date, n long, value double"
GRID = "person_id long, lo date, hi date"


def test_breaches_are_counted_in_one_pass_and_raised_together(spark):
    data = spark.createDataFrame(
        [(1, 2, dt.datetime(2020, 1, 1), 1.0), (None, 2, dt.datetime(2020, 1, 1), None), (None, 2, None, float("nan"))], EHR)
    checks = K.Checks()
    assert len(checks.watch(data, "events", K.event_rules()).collect()) == 3
    assert checks.report() == [
        ("events", "a person", 3, 2), ("events", "a concept", 3, 0), ("events", "a moment", 3, 1), ("events", "a finite value", 3, 1)]
    with pytest.raises(ValueError, match=r"a person \(2 of 3 rows\); .*a moment \(1 of 3"):
        checks.verify()


def test_an_unknown_outcome_is_a_breach_and_an_empty_table_has_none(spark):
    rows = spark.createDataFrame([(None,), (1,)], "k long")
    with pytest.raises(ValueError, match="positive .1 of 2 rows"):
        K.kept_checked(rows, "rows", {"positive": F.col("k") > 0})
    kept = K.kept_checked(rows.where("k > 9"), "rows", {"positive": F.col("k") > 0})
    assert kept.count() == 0


def test_visits_must_have_both_ends_in_order(spark):
    at = [dt.datetime(2020, 1, i) for i in (1, 2)]
    good = spark.createDataFrame([(1, at[0], at[1]), (1, at[1], at[1])], VISITS)
    assert K.kept_checked(good, "visits", K.visit_rules()).count() == 2
    for bad, what in (((1, at[0], None), "an end"), ((1, at[1], at[0]), "start before end"), ((None, *at), "a person")):
        with pytest.raises(ValueError, match=what):
            K.kept_checked(spark.createDataFrame([bad], VISITS), "visits", K.visit_rules())


@pytest.mark.parametrize("rows,grid,what", [
    ([(1, 5, DAYS[3], 1, 2.0)], [(1, DAYS[0], DAYS[2])], "a day on the grid"),
    ([(1, 5, DAYS[1], 1, 2.0), (1, 5, DAYS[1], 1, 3.0)], [(1, DAYS[0], DAYS[2])], "one row per day"),
    ([(1, 5, DAYS[0], 1, 2.0)], [(1, DAYS[0], DAYS[0])], "two days of grid"),
    ([(1, 5, DAYS[0], 1, 2.0)], [(2, DAYS[0], DAYS[2])], "a day on the grid"),
    ([(1, 5, DAYS[0], 0, 2.0)], [(1, DAYS[0], DAYS[2])], "an event"),
    ([(1, 5, DAYS[0], 1, float("inf"))], [(1, DAYS[0], DAYS[2])], "a finite value"),
])
def test_daily_rows_off_their_grid_raise(spark, rows, grid, what):
    daily, days = spark.createDataFrame(rows, DAILY), spark.createDataFrame(grid, GRID)
    with pytest.raises(ValueError, match=what):
        U.checked_daily(daily, days)


def test_validated_curves_equal_plain_ones_and_rows_off_the_bounds_raise(spark):
    daily = spark.createDataFrame([(1, 5, DAYS[0], 1, 2.0), (1, 5, DAYS[3], 1, 8.0)], DAILY)
    meta = spark.createDataFrame([(5, "Measurement")], "concept_id long, data_mode string")
    options = U.CurveOptions.windowed(None)
    plain = U.curves_of_daily(daily, meta, None, options).collect()
    assert sorted(plain) == sorted(U.curves_of_daily(daily, meta, None, options, validate=True).collect())
    bounds = spark.createDataFrame([(1, DAYS[0], DAYS[2])], "person_id long, start date, until date")
    with pytest.raises(ValueError, match="a day on the grid .1 of 2 rows"):
        U.curves_of_daily(daily, meta, bounds, options, validate=True)


def test_wrong_types_raise_before_anything_runs(spark):
    daily = spark.createDataFrame([(1, 5, "2020-01-01", 1, 2.0)], DAILY.replace("day date", "day string"))
    grid = spark.createDataFrame([(1, DAYS[0], DAYS[2])], GRID)
    with pytest.raises(ValueError, match="day is string, not date"):
        U.checked_daily(daily, grid)
    with pytest.raises(ValueError, match="n is missing"):
        K.require_types(grid, "grid", {"n": EHR["person_id"].dataType})


def test_the_check_adds_no_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5, DAYS[0], 1, 2.0)], DAILY).write.parquet(str(tmp_path / "d"))
    daily = spark.read.parquet(str(tmp_path / "d"))
    watched = K.Checks().watch(daily, "daily rows", {"an event": F.col("n") > 0})
    plan = watched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
