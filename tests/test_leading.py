import numpy as np
import pytest

from longspan.operators import leading as C
from longspan.operators import linalg as L
from tests.test_linalg import rows_of, values


def decaying(n, k, rank, seed=0, shift=1e4):
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(n, rank)))[0], np.linalg.qr(rng.normal(size=(k, rank)))[0]
    return left * np.exp(-0.4 * np.arange(rank)) * np.sqrt(n) @ right.T + shift


def truth(x):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    return values[::-1], vectors[:, ::-1].T


@pytest.mark.parametrize("n,k,rank,wanted", [(300, 120, 40, 6), (30, 90, 20, 5), (200, 8, 8, 8)])
def test_leading_components_equal_the_eigenvectors(spark, n, k, rank, wanted):
    x = decaying(n, k, rank)
    found = C.leading_components(rows_of(spark, x), wanted, oversample=4)
    lam, vec = truth(x)
    assert found.n == n
    np.testing.assert_allclose(found.mean, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(found.values, lam[:len(found.values)], rtol=1e-6)
    assert len(found.values) == wanted
    np.testing.assert_allclose(np.abs(np.sum(found.vectors * vec[:wanted], axis=1)), 1, atol=1e-6)
    np.testing.assert_allclose(found.vectors @ found.vectors.T, np.eye(wanted), atol=1e-9)


def test_rounds_mend_a_flat_spectrum(spark):
    x = np.random.default_rng(1).normal(size=(400, 30)) * np.linspace(2, 1, 30)
    found = C.leading_components(rows_of(spark, x).coalesce(2), 3, oversample=17)
    np.testing.assert_allclose(found.values, truth(x)[0][:3], rtol=1e-6)


def test_whitening_from_the_range_finder(spark):
    x = decaying(300, 50, 30)
    matrix = rows_of(spark, x)
    fast, full = C.leading_whitening(matrix, 4), L.learn_whitening(matrix, 4)
    np.testing.assert_allclose(fast.k, full.k, atol=1e-4)
    white = values(fast.apply(matrix))
    np.testing.assert_allclose(np.cov(white.T, bias=True), np.eye(4), atol=1e-6)


def test_rank_and_refusals(spark, monkeypatch):
    low = decaying(100, 30, 3)
    assert len(C.leading_components(rows_of(spark, low), 8).values) == 3
    assert len(C.leading_components(rows_of(spark, np.ones((5, 4))), 2).values) == 0
    with pytest.raises(ValueError, match="positive"):
        C.leading_components(rows_of(spark, low), 0)
    with pytest.raises(ValueError, match="no rows"):
        C.leading_components(rows_of(spark, low).limit(0), 2)
    with pytest.raises(Exception, match="one size"):
        uneven = rows_of(spark, low).unionByName(rows_of(spark, low[:, :3]))
        C.leading_components(uneven, 2)
    monkeypatch.setattr(C, "MAX_SKETCH", 100)
    with pytest.raises(ValueError, match="exceed"):
        C.leading_components(rows_of(spark, low), 8)


def test_factors_of_many_partitions_and_empty_ones(spark):
    x = decaying(50, 20, 10)
    lam = truth(x)[0]
    for parts in (1, 23):
        found = C.leading_components(rows_of(spark, x).repartition(parts), 4, oversample=4)
        np.testing.assert_allclose(found.values, lam[:4], rtol=1e-6)
