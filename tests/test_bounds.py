"""Checks that raise instead of losing rows, prefix sums of three levels, kept state."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from longspan.operators import curves, matrix, running, stats
from longspan.streaming.online_scaler import OnlineScaler

STATS = "label long, count long, mean double, variance double, negative long, minval double, maxval double"
SCALER = "label long, shift double, scale double, log10 boolean, eps double"


def test_prefix_sums_over_many_blocks(spark):
    rows = spark.range(500).select(
        "id", (F.col("id") % 7).alias("n"), F.floor(F.col("id") / 5).alias("bucket"), (F.col("id") % 2).alias("k"))
    found = running.running_total(rows, "bucket", ["id"], {"before": "n"}, block_buckets=3).collect()
    assert {r.id: r.before for r in found} == {i: sum(j % 7 for j in range(i)) for i in range(500)}
    keyed = running.running_total(rows, "bucket", ["id"], {"before": "n"}, ("k",), block_buckets=3).collect()
    assert {r.id: r.before for r in keyed} == {i: sum(j % 7 for j in range(i % 2, i, 2)) for i in range(500)}


def test_buckets_grow_in_number_not_in_size():
    assert running.bucket_count(10**12) * running.BUCKET_ROWS >= 10**12


def test_filling_below_the_count_raises(spark):
    known = spark.createDataFrame([(1, 3, 2.0, 0.5, 0, 1.0, 3.0)], STATS)
    assert stats.extend_stats(known, 3).first()["count"] == 3
    with pytest.raises(PySparkException, match="fewer values"):
        stats.extend_stats(known, 1).collect()


def test_labels_without_a_scaler_raise(spark):
    scaler = spark.createDataFrame([(1, 1.0, 2.0, False, 1e-6), (3, 0.0, None, False, 1e-6)], SCALER)
    data = spark.createDataFrame([(1, 5.0), (1, None), (3, 5.0)], "label long, value double")
    found = matrix.apply_scaler(data, scaler)
    assert sorted(((r.label, r.value) for r in found.collect()), key=str) == [(1, 2.0), (1, None), (3, None)]
    other = spark.createDataFrame([(2, 5.0)], "label long, value double")
    for convert in (matrix.apply_scaler, matrix.invert_scaler):
        with pytest.raises(PySparkException, match="no scaler for label 2"):
            convert(other, scaler).collect()


def test_samples_off_the_grid_raise_unless_dropped(spark):
    day = dt.date(2020, 1, 1)
    built = spark.createDataFrame([(1, 9, day, 4.0)], "person_id long, concept_id long, day date, value double")
    grid = spark.createDataFrame([(1, day, day)], "person_id long, lo date, hi date")
    on = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 5))], "person_id long, datetime timestamp_ntz")
    off = spark.createDataFrame([(1, dt.datetime(2020, 1, 2, 5))], "person_id long, datetime timestamp_ntz")
    assert curves.cross_section(built, on, grid).count() == 1
    assert curves.cross_section(built, on).count() == 1
    assert curves.cross_section(built, off, off_grid="drop").count() == 0
    for days in (grid, None):
        with pytest.raises(PySparkException, match="outside the days of its person: person 1, 2020-01-02"):
            curves.cross_section(built, off, days).collect()
    with pytest.raises(ValueError, match="raise or drop"):
        curves.cross_section(built, off, off_grid="skip")


def test_a_new_scaler_goes_on_from_the_kept_state(spark, tmp_path):
    def batch(*values):
        return spark.createDataFrame([(0, float(v)) for v in values], "label long, value double")

    first = OnlineScaler(spark, "s", folder=str(tmp_path))
    assert first.version == -1
    first.update(batch(1, 2), 0)
    first.update(batch(3), 1)
    again = OnlineScaler(spark.newSession(), "s", folder=str(tmp_path))
    assert again.version == 1
    again.update(batch(9), 1)  # merged before the restart
    again.update(batch(6), 2)
    got = again.stats.first()
    assert (got["count"], got["mean"]) == (4, pytest.approx(3.0))
    again.reset()
    fresh = OnlineScaler(spark, "s", folder=str(tmp_path))
    fresh.update(batch(5), 3)
    assert (fresh.stats.first()["count"], fresh.stats.first()["mean"]) == (1, 5.0)
