import itertools

import numpy as np
import pytest

from longspan.operators import affinity as A
from longspan.operators import linalg as L


def rows_of(spark, x, name="obs_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 f"{name} long, features array<double>").repartition(5)


def values(df, key="obs_id"):
    return np.array([r.features for r in df.orderBy(key).collect()])


@pytest.mark.parametrize("n,k", [(1, 1), (300, 20), (10, 15)])
def test_covariance(spark, n, k):
    x = np.random.default_rng(0).random((n, k)) + 1e6
    cov, mean, count = L.covariance(rows_of(spark, x))
    assert count == n
    np.testing.assert_allclose(cov, np.atleast_2d(np.cov(x.T, bias=True)), atol=1e-8)
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-12)


def test_whitening(spark):
    x = np.random.default_rng(1).random((400, 12)) @ np.random.default_rng(2).random((12, 12))
    matrix = rows_of(spark, x)
    whitening = L.learn_whitening(matrix, 6)
    white = values(whitening.apply(matrix))
    assert whitening.k.shape == (6, 12)
    np.testing.assert_allclose(white.mean(axis=0), 0, atol=1e-8)
    np.testing.assert_allclose(np.cov(white.T, bias=True), np.eye(6), atol=1e-8)
    singular = np.sqrt(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    assert len(L.learn_whitening(matrix, None, singular[4] - 1e-9).k) == 5
    assert len(L.learn_whitening(matrix, 0, singular[4] - 1e-9).k) == 5
    assert len(L.learn_whitening(matrix, -1).k) == 12
    with pytest.raises(ValueError):
        L.learn_whitening(matrix)
    with pytest.raises(ValueError):
        L.learn_whitening(matrix, -2)
    with pytest.raises(RuntimeError):
        L.learn_whitening(matrix, None, 1e9)


def test_fastica_recovers_mixed_signals(spark, tmp_path):
    t = np.linspace(0, 8, 2000)
    s = np.c_[np.sin(2 * t), np.sign(np.sin(3 * t)), 2 * ((t * 0.7) % 1) - 1]
    s += 0.1 * np.random.default_rng(0).normal(size=s.shape)
    s /= s.std(axis=0)
    x = s @ np.array([[1, 1, 1], [0.5, 2, 1], [1.5, 1, 2]]).T
    matrix = rows_of(spark, x)
    whitening = L.learn_whitening(matrix, 3)
    white = whitening.apply(matrix).persist()
    w, steps = L.fastica(white, np.random.default_rng(3).normal(size=(3, 3)), tol=1e-5, checkpoint_every=1)
    assert steps < 200
    np.testing.assert_allclose(w @ w.T, np.eye(3), atol=1e-8)
    found = values(L.sources(white, w))
    match = np.abs(np.corrcoef(found.T, s.T)[:3, 3:])
    assert np.all(match.max(axis=1) > 0.95) and set(match.argmax(axis=1)) == {0, 1, 2}
    np.testing.assert_allclose(values(L.apply_model(matrix, w, whitening)), found, atol=1e-8)
    mixing = L.mixing(w, whitening.k)
    np.testing.assert_allclose(found @ mixing.T + x.mean(axis=0), x, atol=1e-6)
    scaled, at, factors = L.scale_to_unit_variance(L.sources(white, w), mixing.T, 2.0, True)
    new = values(scaled)
    np.testing.assert_allclose(new.std(axis=0, ddof=1), 0.5, atol=1e-8)
    assert np.all(new.max(axis=0) >= -new.min(axis=0))
    np.testing.assert_allclose(new @ at, found @ mixing.T, atol=1e-8)
    path = L.save_weights(white, w, 7)
    np.testing.assert_allclose(L.load_weights(spark, path), w)
    # One more step from the answer changes nothing.
    assert L.fastica(white, w, tol=1e-3, start_iter=steps)[1] == steps + 1
    with pytest.raises(ValueError):
        L.fastica(white, np.eye(2))


def test_fixed_point_parts():
    rng = np.random.default_rng(4)
    w = rng.random((6, 6))
    d = L.decorrelate(w)
    np.testing.assert_allclose(d @ d.T, np.eye(6), atol=1e-8)
    np.testing.assert_allclose(L.decorrelate(d), d, atol=1e-8)
    assert L.max_change(d, -d) == pytest.approx(0, abs=1e-9)
    u = rng.random((3, 4))
    g, slope = L.tanh_nonlinearity(u)
    np.testing.assert_allclose(slope, 1 - np.tanh(u) ** 2)


def test_affinity_over_feature_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 3)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(4, 10)), rng.normal(size=(6, 10))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    wanted = (unit(a) @ unit(b).T) ** 2
    pairs = A.affinity(rows_of(spark, a, "component"), rows_of(spark, b, "component"))
    got = np.full((4, 6), np.nan)
    for r in pairs.collect():
        got[r.a, r.b] = r.affinity
    np.testing.assert_allclose(got, wanted, atol=1e-9)
    best = {r.a: (r.b, r.place) for r in A.max_affinity(pairs).collect()}
    order = np.argsort(-wanted.max(axis=1))
    assert {k: v[0] for k, v in best.items()} == dict(enumerate(wanted.argmax(axis=1)))
    assert [best[i][1] for i in order] == [0, 1, 2, 3]
    for by, table in (("a", wanted), ("b", wanted.T)):
        found = A.optimal_matching(pairs, by).collect()
        assert len(found) == 4
        best_total = max(sum(wanted[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
        assert sum(r.affinity for r in found) == pytest.approx(best_total)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 3), (4, 6), (5, 5)])
def test_assignment_is_optimal(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(10):
        c = rng.normal(size=(n, m))
        found = A.assignment(c)
        assert len(set(found)) == n
        best = max(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(c[i, j] for i, j in enumerate(found)) == pytest.approx(best)


def test_affinity_in_blocks_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 10)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(25, 64)), rng.normal(size=(70, 64))
    left, right = rows_of(spark, a, "component"), rows_of(spark, b, "component")
    products = A._products(left, right, "component", "features")
    assert products.select("a", "y").distinct().count() == 25 * 7
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    wanted = (unit(a) @ unit(b).T) ** 2
    for table, found in ((wanted, A.best_partners(left, right)), (wanted.T, A.best_partners(right, left))):
        rows = {r.a: r for r in found.collect()}
        assert {k: r.b for k, r in rows.items()} == dict(enumerate(table.argmax(axis=1)))
        order = np.argsort(-table.max(axis=1))
        assert [rows[i].place for i in order] == list(range(len(table)))
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "SinglePartition" not in plan


def test_affinity_of_ties_and_empty_sets(spark):
    same = rows_of(spark, np.ones((3, 4)), "component")
    assert {(r.a, r.b) for r in A.best_partners(same, same).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert A.best_partners(same, same.limit(0)).count() == 0
    assert A.cosine_similarity(same.limit(0), same).count() == 0


def test_wide_covariance_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 7)
    x = np.random.default_rng(3).random((60, 20)) + 1e5
    matrix = rows_of(spark, x)
    wanted = np.cov(x.T, bias=True)
    got = np.full((20, 20), np.nan)
    for r in L.covariance_table(matrix).collect():
        got[r.i, r.j] = r.covariance
    np.testing.assert_allclose(got, wanted, atol=1e-8)
    cov, mean, n = L.covariance(matrix)
    np.testing.assert_allclose(cov, wanted, atol=1e-8)
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-12)
    assert n == 60


def test_partial_sums_do_not_follow_input_partitions(spark):
    x = np.random.default_rng(3).random((300, 6))
    counts = {p: L.gram_parts(rows_of(spark, x).repartition(p), np.zeros(6)).count() for p in (3, 60)}
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert counts[60] <= width * 7 and counts[3] <= 3 * 7


@pytest.mark.parametrize("broken", [None, [1.0], [1.0, None]])
def test_ragged_rows_raise_by_name(spark, broken):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, broken)], "obs_id long, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="feature arrays"):
        L.covariance(df)
