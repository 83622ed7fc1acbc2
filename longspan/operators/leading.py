"""Leading components of wide rows by a randomised range finder.

No table of features x features exists, neither on the driver nor on an
executor. Rows are projected on a few directions, the tall projection is
orthogonalised by stacked triangular factors (each task keeps one small factor
of its rows, the factors are stacked and factored again), and the orthogonal
columns applied to the rows give the next directions. All that moves is
features x directions, checked against ``MAX_SKETCH``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.operators.linalg import Whitening, _block, _narrowed, _summed_rows, _width

# Numbers of one set of directions (features x directions): 512 MB on the driver and in each Python worker.
MAX_SKETCH = 2**26


@dataclass(frozen=True)
class Components:
    """Variances, largest first, and unit vectors as rows; rows of constant data have none."""

    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    n: int


def _centred(block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    if block.shape[1] != len(mean):
        raise ValueError("feature arrays must be of one size, without NULL")
    return block - mean


def _mean(matrix: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Mean and number of rows, summed from the first row on, so that large means cost no digits."""
    first = matrix.select(column).first()[0]
    if first is None or any(v is None for v in first):
        raise ValueError("feature arrays must be of one size, without NULL")
    shift = np.array(first, dtype=float)

    def partial(block: np.ndarray) -> np.ndarray:
        counted = np.zeros((1, len(shift)))
        counted[0, 0] = len(block)
        return np.vstack([_centred(block, shift).sum(axis=0), counted])

    rows = _summed_rows(matrix, column, partial)
    n = int(round(rows[1][0]))
    return shift + rows[0] / n, n


def _small(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["row"])


def _stacked(total: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if total is None else np.vstack([total, rows]), mode="r")


def triangular_factor(matrix: DataFrame, shared: Broadcast, column: str = "features") -> np.ndarray:
    """R of the rows projected on ``shared`` (mean, directions), in three levels of stacked factors.

    A task holds one factor of directions x directions. About the square root of the number of
    tasks of them are stacked in a second step, and the driver factors what is left.
    """
    width = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                total = _stacked(total, _centred(_block(batch, column), mean) @ directions)
        if total is not None:
            yield _small(total)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = _stacked(total, _block(batch, "row"))
        yield _small(total)

    factors = _narrowed(matrix.select(column)).mapInArrow(local, "row array<double>")
    placed = factors.select("row", (F.spark_partition_id() % int(np.ceil(np.sqrt(width)))).alias("stack"))
    merged = placed.groupBy("stack").applyInArrow(joined, "row array<double>")
    return np.linalg.qr(np.array([r["row"] for r in merged.collect()]), mode="r")


def leading_components(
    matrix: DataFrame, n_component: int, oversample: int = 10, max_iter: int = 30, tol: float = 1e-9,
    seed: int = 0, column: str = "features",
) -> Components:
    """The ``n_component`` directions of largest variance, without a covariance matrix.

    Two passes over the rows per round; rounds end when no wanted variance changes by more than
    ``tol`` of the largest, or after ``max_iter``. Directions beyond the rank of the rows
    are left out, so fewer components may come back. A directions x features
    matrix is all that the driver sees.
    """
    if n_component < 1:
        raise ValueError("n_component must be positive")
    k = _width(matrix, column)
    p = min(k, n_component + oversample)
    if k * p > MAX_SKETCH:
        raise ValueError(f"{k} features by {p} directions exceed {MAX_SKETCH} numbers")
    mean, n = _mean(matrix, column)
    directions = np.random.default_rng(seed).standard_normal((k, p))
    values = np.zeros(0)
    for _ in range(max_iter):
        shared = matrix.sparkSession.sparkContext.broadcast((mean, directions))
        try:
            _, size, turn = np.linalg.svd(triangular_factor(matrix, shared, column))
            kept = size > size[0] * 1e-13 if size[0] > 0 else np.zeros(len(size), dtype=bool)
            if not kept.any():
                return Components(np.zeros(0), np.zeros((0, k)), mean, n)
            back = turn[kept].T / size[kept]  # makes the projected rows orthonormal

            def partial(block: np.ndarray) -> np.ndarray:
                centre, along = shared.value
                rows = _centred(block, centre)
                return (rows @ along @ back).T @ rows

            sums = _summed_rows(matrix, column, partial)
        finally:
            shared.unpersist()
        _, singular, vectors = np.linalg.svd(np.stack([sums[i] for i in range(len(sums))]), full_matrices=False)
        before, values = values, singular**2 / n
        if p == k or (len(before) == len(values)
                      and np.max(np.abs(before - values)[:n_component]) <= tol * values[0]):
            break
        directions = vectors.T
    real = values > values[0] * 1e-13
    real[n_component:] = False
    return Components(values[real], vectors[real], mean, n)


def leading_whitening(matrix: DataFrame, n_component: int, column: str = "features", **options) -> Whitening:
    """Whitening by the leading components; each has a first weight that is not negative."""
    found = leading_components(matrix, n_component, column=column, **options)
    sign = np.where(found.vectors[:, :1] < 0, -1.0, 1.0)
    return Whitening(found.vectors * sign / np.sqrt(found.values)[:, None], found.mean)
