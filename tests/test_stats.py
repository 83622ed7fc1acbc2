import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import matrix as M
from longspan.operators import stats as T
from longspan.operators.quantiles import exact_quantiles

FIELDS = ("count", "mean", "variance", "negative", "minval", "maxval")


def long(spark, data, labels=None):
    labels = range(len(data)) if labels is None else labels
    rows = [(int(k), float(v)) for k, row in zip(labels, data) for v in row]
    return spark.createDataFrame(rows, "label long, value double")


def table(stats):
    return {r.label: tuple(r[f] for f in FIELDS) for r in stats.collect()}


def direct(data, labels=None):
    labels = range(len(data)) if labels is None else labels
    out = {}
    for k, row in zip(labels, data):
        row = row[np.isfinite(row)]
        if len(row):
            out[k] = (len(row), row.mean(), row.var(), int((row < 0).sum()), row.min(), row.max())
    return out


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for k in wanted:
        assert found[k] == pytest.approx(wanted[k], rel=1e-9, abs=1e-9)


@pytest.fixture
def data():
    rng = np.random.default_rng(3)
    return rng.random((10, 200)) * rng.integers(1, 10, (10, 1)) + rng.integers(-10, 10, (10, 1))


def test_collect_with_gaps_and_dead_labels(spark, data):
    data[np.random.default_rng(1).random(data.shape) < 0.25] = np.nan
    data[3] = np.nan
    same(table(T.collect_stats(long(spark, data))), direct(data))
    labels = spark.createDataFrame([(i,) for i in range(10)], "label long")
    kept = T.collect_stats(long(spark, data), labels=labels)
    assert kept.count() == 10
    assert [r.label for r in T.labels_with_gaps(kept).collect()] == [3]


def test_merge_of_overlapping_labels(spark, data):
    other = data[5:] * 2 + 1
    merged = T.merge_stats(T.collect_stats(long(spark, data)), T.collect_stats(long(spark, other, range(5, 10))),
                           T.collect_stats(long(spark, other, range(20, 25))))
    wanted = direct(data)
    wanted.update(direct([np.concatenate([data[5 + i], other[i]]) for i in range(5)], range(5, 10)))
    wanted.update(direct(other, range(20, 25)))
    same(table(merged), wanted)


def test_merge_does_not_cancel_large_means(spark):
    a, b = 1e9 + np.random.default_rng(0).random(100), 1e9 + np.random.default_rng(1).random(100)
    merged = T.merge_stats(T.collect_stats(long(spark, [a])), T.collect_stats(long(spark, [b])))
    assert table(merged)[0][2] == pytest.approx(np.concatenate([a, b]).var(), rel=1e-4)


@pytest.mark.parametrize("fill", [0.0, -1.0, 1e-6])
def test_extension_equals_padding(spark, data, fill):
    padded = np.hstack([data, np.full((10, 300), fill)])
    same(table(T.extend_stats(T.collect_stats(long(spark, data)), 500, fill)), direct(padded))


def test_extension_without_padding_still_takes_in_the_fill(spark, data):
    found = table(T.extend_stats(T.collect_stats(long(spark, data)), 200, 99.0))
    assert all(v[5] == 99.0 and v[0] == 200 for v in found.values())


def test_pooling_some_labels(spark, data):
    groups = spark.createDataFrame([(0, "g"), (4, "g"), (7, "g"), (77, "g")], "label long, group string")
    wanted = direct(data)
    joint = direct([np.concatenate([data[0], data[4], data[7]])])[0]
    wanted.update({0: joint, 4: joint, 7: joint})
    same(table(T.pool_stats(T.collect_stats(long(spark, data)), groups)), wanted)


def test_one_pass_with_logarithms(spark, data):
    base, lg10 = T.collect_with_log10(long(spark, data))
    same(table(base), direct(data))
    with np.errstate(invalid="ignore", divide="ignore"):
        same(table(lg10), direct(np.log10(data)))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_of_all_kinds_of_numbers(spark, limit):
    rng = np.random.default_rng(4)
    groups = {
        "mixed": np.concatenate([rng.normal(0, 1e-9, 50), rng.normal(0, 1e9, 50), [0.0, -0.0, 5.0, 5.0, 5.0]]),
        "single": np.array([2.5]),
        "many": np.round(rng.random(3000), 2),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("mixed", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.0, 0.0001, 0.25, 0.5, 0.9, 1.0]
    found = {r.k: r.quantiles for r in exact_quantiles(df, ["k"], "v", probabilities, limit).collect()}
    for k, vs in groups.items():
        assert found[k] == pytest.approx(list(np.quantile(vs, probabilities)), rel=1e-12)


# --- standardisation -------------------------------------------------------


def scaler_of(spark, data, modes, params, n_obs=None):
    base, lg10 = T.collect_with_log10(long(spark, data))
    table = spark.createDataFrame(list(modes.items()), "label long, data_mode string")
    return {r.label: r for r in M.make_scaler(base, lg10, table, n_obs, params).collect()}


def test_scaler_kinds(spark):
    rng = np.random.default_rng(5)
    data = np.vstack([rng.random((3, 100)) + 1, np.full((1, 100), 7.0), rng.normal(0, 1, (1, 100))])
    params = {
        "id": M.ModeParams("identity"), "std": M.ModeParams("standard"), "gel": M.ModeParams("gelman"),
        "back": M.ModeParams("gelman_with_fallbacks", log=True),
    }
    got = scaler_of(spark, data, {0: "id", 1: "std", 2: "gel", 3: "back", 4: "back"}, params)
    assert (got[0].shift, got[0].scale) == (0.0, 1.0)
    assert (got[1].shift, got[1].scale) == pytest.approx((data[1].mean(), data[1].std()))
    assert got[2].scale == pytest.approx(2 * data[2].std())
    assert (got[3].shift, got[3].scale, got[3].log10) == (7.0, 1.0, False)  # constant
    assert got[4].log10 is False and got[4].shift == pytest.approx(data[4].mean())  # negatives


def test_scaler_fills_and_pools_by_mode(spark):
    rng = np.random.default_rng(6)
    data = rng.random((4, 50)) + 0.5
    modes = {0: "Condition", 1: "Condition", 2: "Medication", 3: "Procedure"}
    got = scaler_of(spark, data, modes, M.DEFAULT_PARAMS, 200)
    logs = np.concatenate([np.log10(data[:2]).ravel(), np.full(300, -6.0)])
    assert got[0].scale == pytest.approx(2 * logs.std()) and got[0].shift == 0.0 and got[0].log10
    assert got[1].scale == pytest.approx(got[0].scale)
    assert got[2].scale == pytest.approx(2 * np.concatenate([data[2], np.zeros(150)]).std())
    assert got[3].scale == pytest.approx(2 * np.concatenate([data[3], np.zeros(150)]).std())
    with pytest.raises(ValueError):
        scaler_of(spark, data, modes, M.DEFAULT_PARAMS)
    with pytest.raises(ValueError):
        scaler_of(spark, data, {**modes, 3: "Unheard"}, M.DEFAULT_PARAMS, 200)
    with pytest.raises(ValueError):
        M.ModeParams("unheard")


def test_impact_texts(spark):
    scaler = spark.createDataFrame([(1, 1.0, 2.0, False, 1e-6), (2, 0.0, 1.0, True, 0.0)],
                                   "label long, shift double, scale double, log10 boolean, eps double")
    deltas = spark.createDataFrame([(1, 0.5), (1, -0.5), (2, 1.0), (2, -1.0)], "label long, delta double")
    got = {(r.label, r.delta): r.impact for r in M.impact(deltas, scaler).collect()}
    assert got == {(1, 0.5): "+1.00", (1, -0.5): "-1.00", (2, 1.0): "x10.00", (2, -1.0): "/10.00"}


def test_dense_rows_fill_and_keep_empty_observations(spark):
    data = spark.createDataFrame([(1, 20, 5.0), (2, 10, 6.0), (2, 99, 1.0)], "obs long, label long, value double")
    observations = spark.createDataFrame([(1,), (2,), (3,)], "obs long")
    dense = M.dense_rows(data, ["obs"], [10, 20, 30], {10: 0.1, 20: 0.2, 30: 0.3}, observations)
    assert {r.obs: r.features for r in dense.collect()} == {1: [0.1, 5.0, 0.3], 2: [6.0, 0.2, 0.3], 3: [0.1, 0.2, 0.3]}
    M.require_complete(dense)
    with pytest.raises(ValueError):
        M.require_complete(M.dense_rows(data, ["obs"], [10, 20], None, observations))
    long_rows = {(r.obs, r.label): r.value for r in M.dense_long(dense, ["obs"], [10, 20, 30]).collect()}
    assert len(long_rows) == 9 and long_rows[1, 20] == 5.0


def test_dense_rows_of_many_labels_in_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "DENSE_BYTES", 8 * 20_000 * 7)
    wide = 20_000
    rng = np.random.default_rng(8)
    given = {(o, int(l)): float(o + l) for o in range(200) for l in rng.integers(0, wide, 5)}
    data = spark.createDataFrame([(o, l, v) for (o, l), v in given.items()], "obs long, label long, value double").coalesce(2)
    dense = M.dense_rows(data, ["obs"], list(range(wide)), {l: -1.0 for l in range(wide)})
    sums = {r.obs: (r.n, r.s) for r in dense.select(
        "obs", F.size("features").alias("n"), F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()}
    for o in range(200):
        mine = [v for (p, _), v in given.items() if p == o]
        assert sums[o] == (wide, sum(mine) - (wide - len(mine)))


def test_points_off_the_grid_raise_in_the_same_pass(spark):
    noon = dt.datetime(2024, 1, 5, 12)
    index = spark.createDataFrame([(1, noon), (2, noon)], "person_id long, datetime timestamp_ntz")
    samples = spark.createDataFrame([(1, noon.date(), 10, 4.0)], "person_id long, day date, concept_id long, value double")
    meta = spark.createDataFrame([(10, 0.5), (11, 0.25)], "concept_id long, fill_value double")
    cohort = spark.createDataFrame(
        [(p, dt.date(1950, 1, 1), 7, 8) for p in (1, 2)],
        "person_id long, birth_date date, gender_concept_id long, race_concept_id long")
    dense, order = M.assemble_matrix(index, samples, meta, None, cohort, [7, 9], off_grid="fill")
    found = {r.person_id: r.features[1:] for r in dense.collect()}
    assert order[1:] == [7, 9, 10, 11] and found == {1: [1.0, 0.0, 4.0, 0.25], 2: [1.0, 0.0, 0.5, 0.25]}
    with pytest.raises(Exception, match="outside the grid"):
        M.assemble_matrix(index, samples, meta, None, cohort, [7, 9])[0].collect()
    inside, _ = M.assemble_matrix(index.where("person_id = 1"), samples, meta, None, cohort, [7, 9])
    assert inside.count() == 1
    with pytest.raises(ValueError):
        M.assemble_matrix(index, samples, meta, None, cohort, [7], off_grid="skip")


def test_impact_rounds_halves_away_from_zero_and_needs_a_scaler(spark):
    scaler = spark.createDataFrame([(1, 0.0, 1.0, False, 1e-6)], "label long, shift double, scale double, log10 boolean, eps double")
    deltas = spark.createDataFrame([(1, 0.125), (1, -0.125), (1, 0.0)], "label long, delta double")
    got = {r.delta: r.impact for r in M.impact(deltas, scaler).collect()}
    assert got == {0.125: "+0.13", -0.125: "-0.13", 0.0: "+0.00"}
    with pytest.raises(Exception, match="no scaler for label 5"):
        M.impact(deltas.withColumn("label", F.lit(5).cast("long")), scaler).collect()


def test_wide_rows_come_back_from_one_shuffle(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (2, "b", 2.0), (2, "z", 9.0), (3, "z", 9.0), (None, "a", 4.0), (4, None, 5.0)]
    wide = T.long_to_wide(spark.createDataFrame(rows, "key long, label string, value double"), "key", ["a", "b"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert wide.columns == ["key", "a", "b"]
    assert {tuple(r) for r in wide.collect()} == {
        (1, 1.0, None), (2, None, 2.0), (3, None, None), (None, 4.0, None), (4, None, None)}
