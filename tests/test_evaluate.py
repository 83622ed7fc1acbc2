import math
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.functions.text import short_label, shorten
from longspan.operators import datasets as D
from longspan.operators import evaluate as E
from longspan.operators import running as N


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(y, s))],
                               "label int, score double, g int")
    assert E.auc(df).first()["auc"] == pytest.approx(brute_auc(y, s))
    for r in E.auc(df, ("g",)).collect():
        pick = np.arange(300) % 3 == r.g
        assert r.auc == pytest.approx(brute_auc(y[pick], s[pick]))


def test_bootstrap_draws_until_a_positive_appears(spark):
    rows = [(i, int(i == 0), float(i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    found = E.auc_bootstrap(df, "id", n=12, seed=1)
    assert found.count() == 12 and found.filter("auc between 0 and 1").count() == 12
    none = df.withColumn("label", F.lit(0))
    with pytest.raises(RuntimeError):
        E.auc_bootstrap(none, "id", n=2, max_attempts=2)


def test_bootstrap_scatters_around_the_value(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = y * 0.5 + rng.random(400)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "id long, label int, score double")
    values = [r.auc for r in E.auc_bootstrap(df, "id", n=30, seed=2).collect()]
    assert abs(np.mean(values) - brute_auc(y, s)) < 0.02 and 0.001 < np.std(values) < 0.05


def test_bootstrap_in_small_pieces_reads_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(E, "SCORES_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 60, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    once = E.materialise(df).mapInArrow(count, df.schema)
    values = [r.auc for r in E.auc_bootstrap(once, n=100, seed=4).collect()]
    assert len(values) == 100 and abs(np.mean(values) - brute_auc(y, s)) < 0.02 and np.std(values) > 0.005
    # The cuts of the range shuffle are sampled in a pass of their own; resamples add none.
    assert seen.value <= 2 * 300


def test_replicates_equal_weighted_areas(spark):
    rng = np.random.default_rng(5)
    y, s, w = rng.integers(0, 2, 90), rng.integers(0, 20, 90), rng.integers(0, 4, (90, 5))
    df = spark.createDataFrame([(int(a), float(b), [float(v) for v in c]) for a, b, c in zip(y, s, w)],
                               "label int, score double, weights array<double>")
    found = {r.replicate: r.auc for r in E.auc_replicates(df, "weights", 5).collect()}
    for r in range(5):
        assert found[r] == pytest.approx(brute_auc(np.repeat(y, w[:, r]), np.repeat(s, w[:, r])))


def test_nll_reductions(spark):
    rng = np.random.default_rng(2)
    mean, var = rng.uniform(3.5, 4.5, 120), rng.random(120)
    df = spark.createDataFrame([(float(a), 4.0, float(b)) for a, b in zip(mean, var)],
                               "mean double, target double, variance double")
    held = np.maximum(var, 1e-6)
    each = 0.5 * (np.log(held) + (mean - 4) ** 2 / held)
    assert E.nll_loss(df, "mean").first()[0] == pytest.approx(each.mean())
    assert E.nll_loss(df, "sum").first()[0] == pytest.approx(each.sum())
    assert E.nll_loss(df, "none", full=True).agg(F.sum("loss")).first()[0] == pytest.approx(
        (each + 0.5 * math.log(2 * math.pi)).sum())
    with pytest.raises(Exception, match="negative variance"):
        E.nll_loss(df.withColumn("variance", -F.col("variance"))).collect()


def test_forest_predicts_out_of_fold(spark):
    rng = np.random.default_rng(3)
    y = np.r_[np.zeros(90), np.ones(30)]
    x = rng.normal(size=(120, 3)) + y[:, None] * 1.5
    df = spark.createDataFrame([(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(x, y))],
                               "id long, features array<double>, label int")
    models, scores, predictions = E.cross_validated_forest(df, "id", folds=3, trees=10)
    assert len(models) == 3 and predictions.select("id").distinct().count() == 120
    assert min(r.auc for r in scores.collect()) > 0.8
    per_fold = {r.fold: r.n for r in predictions.groupBy("fold").agg(F.sum("label").alias("n")).collect()}
    assert set(per_fold.values()) == {10}


def test_random_subset_is_ordered_and_masked(spark):
    df = spark.range(100).select("id", (F.col("id") * 37 % 100).cast("double").alias("v"))
    got = [r.v for r in E.sampled_by_value(df, "id", "v", 10, 1, F.col("id") < 50).collect()]
    assert len(got) == 10 and got == sorted(got)
    assert E.sampled_by_value(df, "id", "v", 1000).count() == 100


# --- text ----------------------------------------------------------------------

NAMES = {
    "Carbon dioxide, total [Moles/volume] in Blood": "Carbon dioxide, total [mol/V] in B",
    "Glucose [Mass/volume] in Serum, Plasma, or Blood": "Glucose [M/V] in SPB",
    "Neutrophils [#/Volume] in Blood by Automated count": "Neutrophils [#/V] in B by AC",
    "Hematocrit [Volume Fraction] of Blood": "Hematocrit [VF] of Blood",
    "a [Mass] b [Time/area]  c_d": "a [Mass] b [T/A] c d",
    "no_units   here": "no units here",
    "odd [Thing/other] x": "odd [Thing/other] x",
}


def test_labels(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.name: r.label for r in df.select("name", short_label(F.col("name")).alias("label")).collect()}
    assert got == NAMES


def test_shortening_equals_the_standard_library(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "be", "well-known", "x-ray", "supercalifragilistic", "a", "to-do-list", "3-4", "gamma,"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(200)] + ["", "   ", "abcdefghijklmnop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width in (8, 15, 40):
        for r in df.select("t", shorten(F.col("t"), width).alias("s")).collect():
            assert r.s == textwrap.shorten(r.t, width, placeholder="..."), (r.t, width)


# --- datasets --------------------------------------------------------------------


def test_batches_cover_everything_once(spark):
    df = spark.range(100)
    for drop, sizes in ((False, [32, 32, 32, 4]), (True, [32, 32, 32])):
        rows = D.batches(df, "id", 32, drop_last=drop, seed=5).collect()
        assert [sum(r.batch == b for r in rows) for b in range(len(sizes))] == sizes
        assert len({r.id for r in rows}) == len(rows) == sum(sizes)
    first = {r.id for r in D.batches(df, "id", 32, seed=5).filter("batch = 0").collect()}
    again = {r.id for r in D.batches(df, "id", 32, seed=6).filter("batch = 0").collect()}
    assert first != again and first != set(range(32))
    assert D.batch_count(64, 32) == 2 == D.batch_count(65, 32, True)


def test_resample_and_repeat(spark):
    df = spark.range(50)
    found = D.resample(df, "id", 0.5, 3)
    assert found.count() == 25 and found.select("id").distinct().count() < 25
    assert D.repeated(df, 4).groupBy("id").count().filter("count = 4").count() == 50


def test_parts_are_near_equal_runs(spark):
    rows = D.contiguous_parts(spark.range(10), "id", 3).orderBy("id").collect()
    assert [r.part for r in rows] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    few = D.contiguous_parts(spark.range(2), "id", 3).orderBy("id").collect()
    assert [r.part for r in few] == [0, 1]


def test_splits_round_trip(spark, tmp_path):
    make = lambda a, b: spark.createDataFrame([([float(i)], i % 2) for i in range(a, b)], "features array<double>, label int")
    D.save_splits({"train": make(0, 8), "test": make(8, 10)}, str(tmp_path / "d"))
    loaded = D.load_splits(spark, str(tmp_path / "d"))
    assert {k: v.count() for k, v in loaded.items()} == {"train": 8, "test": 2}
    assert D.load_split(spark, str(tmp_path / "d"), "test").count() == 2


def test_threshold_grid_of_many_limits(spark):
    rng = np.random.default_rng(7)
    counts = [(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2))]
    limits = sorted({int(x) for x in rng.integers(1, 70, 40)})
    found = {(r.persons, r.mentions): r.concepts for r in E.threshold_grid(
        spark.createDataFrame(counts, "persons long, mentions long"), limits).collect()}
    assert found == {(p, m): sum(a >= p and b >= m for a, b in counts) for p in limits for m in limits}
    empty = E.threshold_grid(spark.createDataFrame([], "persons long, mentions long"), [1, 2])
    assert [r.concepts for r in empty.collect()] == [0] * 4
