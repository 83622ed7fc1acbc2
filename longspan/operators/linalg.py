"""Covariance, whitening and independent components of observation rows.

Spark holds one row per observation with an array of features. Executors add up
small square blocks with BLAS on Arrow batches; the driver only ever sees
features x features or components x components numbers. The feature count is
checked against ``MAX_FEATURES`` before anything square is collected; covariance
tables stay with the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.session import checkpoint_dir, materialise

# Square results of more features than this do not come to the driver; tables of them have no limit.
MAX_FEATURES = 10_000
# Columns of one tile of a Gram matrix: at most TILE squared numbers are added up in a task.
TILE = 2_048


def _block(batch: pa.RecordBatch, column: str, size: int | None = None) -> np.ndarray:
    """The feature arrays of a batch as an (observations, features) matrix; uneven or absent ones raise."""
    values = batch.column(column)
    flat = values.flatten()
    if values.null_count or flat.null_count or len(flat) % len(values) or (size and len(flat) != size * len(values)) or (
            len(set(values.value_lengths().to_pylist())) > 1):
        raise ValueError("feature arrays must be of one size, without NULL")
    return flat.to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _width(matrix: DataFrame, column: str) -> int:
    row = matrix.select(F.size(column).alias("k")).first()
    if row is None:
        raise ValueError("the matrix has no rows")
    return row["k"]


def feature_count(matrix: DataFrame, column: str = "features") -> int:
    k = _width(matrix, column)
    if k > MAX_FEATURES:
        raise ValueError(f"{k} features exceed {MAX_FEATURES}")
    return k


def _narrowed(matrix: DataFrame) -> DataFrame:
    """No more tasks than the session's shuffle width, each reading several input partitions; nothing moves."""
    return matrix.coalesce(int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _summed_rows(
    matrix: DataFrame, column: str, partial: Callable[[np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """Sum of ``partial`` over all blocks, collected by row of the result.

    Each task folds its batches into one small matrix; the matrices are added
    row by row in a distributed aggregate before the driver sees them.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(_block(batch, column))
                total = part if total is None else total + part
        if total is not None:
            rows = pa.array(list(total), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), type=pa.int32()), rows], ["i", "row"]
            )

    parts = _narrowed(matrix.select(column)).mapInArrow(fold, "i int, row array<double>")
    added = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("v"))
    return {r["i"]: np.array(r["row"]) for r in added.select("i", vector_to_array("v").alias("row")).collect()}


def gram_parts(matrix: DataFrame, shift: np.ndarray, column: str = "features") -> DataFrame:
    """Partial sums of x x^T: left and right tile, i, and the numbers of row i in that tile.

    x is a feature array less ``shift``, and a last 1, which gives sums and count. Columns fall
    into tiles. With one tile a task adds up its rows where they lie; with more, each
    row's part of two tiles goes to one of a fixed number of groups for that pair of tiles. So a task
    holds one tile, and partial sums follow neither the input's partitions nor the rows.
    """
    k = len(shift)
    tiles = -(-(k + 1) // TILE)
    groups = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def moved(batch: pa.RecordBatch) -> np.ndarray:
        block = _block(batch, column, k) - shift
        return np.hstack([block, np.ones((len(block), 1))])

    def emitted(left: int, right: int, total: np.ndarray) -> pa.RecordBatch:
        n = len(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([left] * n, pa.int32()), pa.array([right] * n, pa.int32()),
             pa.array(range(left * TILE, left * TILE + n), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
            ["left", "right", "i", "row"])

    schema = "left int, right int, i long, row array<double>"
    if tiles == 1:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = moved(batch)
                    total = x.T @ x if total is None else total + x.T @ x
            if total is not None:
                yield emitted(0, 0, total)

        return _narrowed(matrix.select(column)).mapInArrow(fold, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                x, stack = moved(batch.slice(low, 64)), stack + 1
                parts = [np.ascontiguousarray(x[:, t * TILE:(t + 1) * TILE]).tobytes() for t in range(tiles)]
                pairs = [(a, b) for a in range(tiles) for b in range(a, tiles)]
                for a, b in pairs:
                    yield pa.RecordBatch.from_pydict({
                        "left": pa.array([a], pa.int32()), "right": pa.array([b], pa.int32()),
                        "group": pa.array([stack % groups], pa.int32()), "rows": pa.array([len(x)], pa.int32()),
                        "x": pa.array([parts[a]], pa.binary()), "y": pa.array([parts[b]], pa.binary())})

    def product(tile: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("rows", "x", "y"))):
                part = np.frombuffer(x).reshape(n, -1).T @ np.frombuffer(y).reshape(n, -1)
                total = part if total is None else total + part
        yield emitted(tile[0].as_py(), tile[1].as_py(), total)

    stacks = matrix.select(column).mapInArrow(cut, "left int, right int, group int, rows int, x binary, y binary")
    return stacks.groupBy("left", "right", "group").applyInArrow(product, schema)


def _gram(matrix: DataFrame, column: str) -> tuple[DataFrame, np.ndarray]:
    """Summed tiles by row, and the shift: the first observation, so that large means do not cancel the variance."""
    _width(matrix, column)
    first = matrix.select(column).first()[0]
    if first is None or any(v is None for v in first):
        raise ValueError("feature arrays must be of one size, without NULL")
    shift = np.array(first, dtype=float)
    added = gram_parts(matrix, shift, column).groupBy("left", "right", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    return added, shift


def covariance(matrix: DataFrame, column: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Population covariance, mean and number of observations, on the driver."""
    k = feature_count(matrix, column)
    rows, shift = _gram(matrix, column)
    gram = np.zeros((k + 1, k + 1))
    for r in rows.collect():
        low = r["right"] * TILE
        gram[r["i"], low:low + len(r["row"])] = r["row"]
    gram = np.triu(gram) + np.triu(gram, 1).T
    n = int(round(gram[k, k]))
    offset = gram[k, :k] / n
    return gram[:k, :k] / n - np.outer(offset, offset), shift + offset, n


def covariance_table(matrix: DataFrame, column: str = "features") -> DataFrame:
    """Covariance as rows (i, j, covariance), for any number of features; nothing square meets the driver."""
    rows, shift = _gram(matrix, column)
    k = len(shift)
    cells = materialise(rows.select("i", F.posexplode("row").alias("at", "v"), "right").select(
        "i", (F.col("right") * TILE + F.col("at")).alias("j"), "v").where("i <= j"))
    # The last column holds the sums and, at its end, the count: one number per feature.
    sums = cells.where(F.col("j") == k).select("i", F.col("v").alias("s"))
    n = sums.where(F.col("i") == k).first()["s"]
    means = sums.where(F.col("i") < k).select("i", (F.col("s") / n).alias("m"))
    upper = cells.where(F.col("j") < k).join(means, "i").join(
        means.select(F.col("i").alias("j"), F.col("m").alias("m2")), "j").select(
        "i", "j", (F.col("v") / n - F.col("m") * F.col("m2")).alias("covariance"))
    return upper.select("i", "j", "covariance").unionByName(
        upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "covariance"))


def project(
    matrix: DataFrame, weights: np.ndarray, offset: np.ndarray | None = None,
    column: str = "features", target: str = "features",
) -> DataFrame:
    """Replace the feature array x by ``weights @ x + offset``."""
    moved = np.zeros(len(weights)) if offset is None else np.asarray(offset, dtype=float)
    across = np.ascontiguousarray(np.asarray(weights, dtype=float).T)

    @F.pandas_udf("array<double>")
    def times(features: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(features.to_numpy()) @ across + moved))

    return matrix.withColumn(target, times(F.col(column)))


@dataclass(frozen=True)
class Whitening:
    """K and the mean: white = K (x - mean)."""

    k: np.ndarray
    mean: np.ndarray

    def apply(self, matrix: DataFrame, column: str = "features") -> DataFrame:
        return project(matrix, self.k, -self.k @ self.mean, column, column)


def learn_whitening(
    matrix: DataFrame, n_component: int | None = None, component_thresh: float | None = None,
    column: str = "features", eps: float | None = None,
) -> Whitening:
    """Whitening from the covariance's eigenvectors, largest first.

    ``n_component`` positive takes that many; None or 0 takes every component
    whose singular value reaches ``component_thresh``; -1 takes all.
    """
    if not n_component and component_thresh is None:
        raise ValueError("give n_component or component_thresh")
    if n_component is not None and n_component < -1:
        raise ValueError("n_component must be positive or -1")
    cov, mean, _ = covariance(matrix, column)
    floor = eps if eps and eps > 0 else np.finfo(float).eps
    values, vectors = np.linalg.eigh(cov)
    singular = np.sqrt(np.maximum(values, floor))
    if n_component == -1:
        n_component = len(singular)
    elif not n_component:
        n_component = int(np.sum(singular >= component_thresh))
        if n_component < 1:
            raise RuntimeError(f"no component reaches {component_thresh}")
    sign = np.where(vectors[0] < 0, -1.0, 1.0)
    rows = (vectors * sign / singular).T
    return Whitening(rows[np.argsort(-singular, kind="stable")[:n_component]], mean)


# --- independent components ----------------------------------------------


def tanh_nonlinearity(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g(u) = tanh(u) and its derivative."""
    g = np.tanh(block)
    return g, 1.0 - g * g


def decorrelate(w: np.ndarray, eps: float | None = None) -> np.ndarray:
    """Symmetric decorrelation (W W^T)^(-1/2) W."""
    floor = np.finfo(w.dtype).eps if eps is None else eps
    values, vectors = np.linalg.eigh(w @ w.T)
    return (vectors / np.sqrt(np.maximum(values, floor))) @ vectors.T @ w


def updated(sums: np.ndarray, w: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """One fixed-point step before decorrelation: E[g x^T] - E[g'] W."""
    return sums - slopes[:, None] * w


def max_change(w: np.ndarray, w1: np.ndarray) -> float:
    """Largest distance of matching rows from being equal up to sign."""
    return float(np.max(np.abs(np.abs(np.sum(w * w1, axis=1)) - 1.0)))


def ica_moments(white: DataFrame, w: np.ndarray, column: str = "features",
                nonlinearity=tanh_nonlinearity) -> tuple[np.ndarray, np.ndarray]:
    """E[g(Wx) x^T] and E[g'(Wx)] over all rows, in one pass."""
    k = len(w)

    def partial(block: np.ndarray) -> np.ndarray:
        g, slope = nonlinearity(block @ w.T)
        counted = np.concatenate([np.full(1, float(len(block))), np.zeros(block.shape[1])])
        return np.vstack([np.hstack([slope.sum(axis=0)[:, None], g.T @ block]), counted])

    rows = _summed_rows(white, column, partial)
    moments = np.stack([rows[i] for i in range(k)]) / rows[k][0]
    return moments[:, 1:], moments[:, 0]


def fastica(
    white: DataFrame, w0: np.ndarray, max_iter: int = 200, tol: float = 1e-4,
    column: str = "features", nonlinearity=tanh_nonlinearity, checkpoint_every: int = 0,
    start_iter: int = 0,
) -> tuple[np.ndarray, int]:
    """Symmetric fixed-point iteration on whitened rows; returns W and the count.

    Each iteration is one pass over the rows that returns components^2 numbers.
    Persist ``white`` to read it from memory; a lost block is recomputed from
    its lineage, so every pass sees the same rows.
    """
    k = feature_count(white, column)
    if w0.shape != (k, k):
        raise ValueError("w0 must be square and match the components")
    w = decorrelate(np.array(w0, dtype=float))
    done = start_iter
    for done in range(start_iter, start_iter + max_iter):
        sums, slopes = ica_moments(white, w, column, nonlinearity)
        following = decorrelate(updated(sums, w, slopes))
        change = max_change(w, following)
        w = following
        if checkpoint_every and done % checkpoint_every == 0:
            save_weights(white, w, done)
        if change < tol:
            break
    return w, done + 1


def save_weights(df: DataFrame, w: np.ndarray, step: int) -> str:
    """Write W as rows (i, weights) to the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/weights/{step:05d}"
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(w)]
    table = spark.createDataFrame(rows, "i int, weights array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_weights(spark, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("i").collect()
    return np.array([r["weights"] for r in rows])


def sources(white: DataFrame, w: np.ndarray, column: str = "features",
            n_samples: int | None = None) -> DataFrame:
    """S = W x1 per row, times 1/sqrt(n_samples) if given."""
    factor = 1.0 if n_samples is None else 1.0 / math.sqrt(n_samples)
    return project(white, w * factor, column=column, target=column)


def mixing(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A, the pseudo-inverse of W K."""
    return np.linalg.pinv(w @ k)


def apply_model(matrix: DataFrame, w: np.ndarray, whitening: Whitening,
                factors: np.ndarray | None = None, column: str = "features") -> DataFrame:
    """Sources of new rows under a learned model, optionally divided by factors."""
    total = w @ whitening.k
    if factors is not None:
        total = total / np.asarray(factors, dtype=float).reshape(-1, 1)
    return project(matrix, total, -total @ whitening.mean, column, column)


def unit_variance_factors(rows: DataFrame, alpha: float = 1.0, sign_flip: bool = False,
                          column: str = "features") -> np.ndarray:
    """Sample deviation per component times alpha; negative where the extreme is."""
    vector = array_to_vector(F.col(column))
    metrics = rows.agg(
        Summarizer.metrics("std", "min", "max").summary(vector).alias("m")
    ).first()["m"]
    factors = metrics["std"].toArray() * alpha
    if sign_flip:
        low, high = metrics["min"].toArray(), metrics["max"].toArray()
        factors = np.where(np.abs(low) > high, -factors, factors)
    return factors


def scale_to_unit_variance(
    rows: DataFrame, mixing_t: np.ndarray, alpha: float = 1.0, sign_flip: bool = False,
    column: str = "features",
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Sources divided and mixing rows multiplied by the factors."""
    factors = unit_variance_factors(rows, alpha, sign_flip, column)
    divisors = F.array(*[F.lit(float(f)) for f in factors])
    scaled = rows.withColumn(column, F.zip_with(column, divisors, lambda a, f: a / f))
    return scaled, mixing_t * factors[:, None], factors
