"""Cosine affinity of two sets of components and their matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.running import ranked

# Features and components handled together in one task.
SLICE = 4096
BLOCK = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_rows(df: DataFrame, column: str = "features") -> DataFrame:
    """Scale every row to length one."""
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    named = df.withColumn("__norm", norm)
    return named.withColumn(column, F.transform(column, lambda v: F.try_divide(v, F.col("__norm")))).drop("__norm")


def _blocked(df: DataFrame, key: str, column: str, side: str, others: int, blocks: int) -> DataFrame:
    """Feature slices of unit rows, for each block of the other side they meet."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(column) - 1) / SLICE).cast("int")),
        lambda s: F.slice(column, s * SLICE + 1, SLICE),
    )
    mine = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(side)
    sliced = unit_rows(df, column).select(F.col(key).alias("key"), mine, F.posexplode(pieces).alias("slice", "part"))
    other = "y" if side == "x" else "x"
    return sliced.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _products(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """One row per component of ``a`` and block of ``b``: a, bs (its keys, ascending), cosines.

    A blocked matrix product: tasks are (block of a, block of b, slice of features) with at
    most about BLOCK components of each side, so the work spreads however few the
    features are; slices are added per row and block.
    """
    n, m = (-(-max(x.count(), 1) // BLOCK) for x in (a, b))
    left, right = _blocked(a, key, column, "x", m, n), _blocked(b, key, column, "y", n, m)

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "y": [], "bs": [], "row": []}, dtype=object)
        y = y.sort_values("key")
        product = np.stack(x["part"].to_numpy()) @ np.stack(y["part"].to_numpy()).T
        keys = y["key"].tolist()
        return pd.DataFrame({"a": x["key"], "y": y["y"].iloc[0], "bs": [keys] * len(x), "row": list(product)})

    tile = ("x", "y", "slice")
    parts = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(
        multiply, "a long, y int, bs array<long>, row array<double>")
    return parts.groupBy("a", "y").agg(
        F.first("bs").alias("bs"), vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))


def cosine_similarity(
    a: DataFrame, b: DataFrame, key: str = "component", column: str = "features"
) -> DataFrame:
    """(a, b, cosine) for every pair of components; the pairs are the answer."""
    return _products(a, b, key, column).select(
        "a", F.explode(F.arrays_zip(F.col("bs").alias("b"), F.col("row").alias("c"))).alias("p")).select(
        "a", F.col("p.b").alias("b"), F.col("p.c").alias("cosine"))


def best_partners(a: DataFrame, b: DataFrame, key: str = "component", column: str = "features") -> DataFrame:
    """(a, b, affinity, place): the best partner of each component of ``a``; the lowest wins a tie.

    The best of each block is taken from its row of products, and those are merged: pairs
    are never rows. ``place`` orders the components from the best to the worst match.
    """
    entries = F.zip_with("bs", "row", lambda k, c: F.struct((c * c).alias("affinity"), (-k).alias("b")))
    best = _products(a, b, key, column).groupBy("a").agg(F.max(F.array_max(entries)).alias("m"))
    return _placed(best.select("a", (-F.col("m.b")).alias("b"), F.col("m.affinity").alias("affinity")), "a")


def affinity(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Squared cosine of every pair."""
    return cosine_similarity(a, b, **options).select("a", "b", (F.col("cosine") ** 2).alias("affinity"))


def _placed(best: DataFrame, by: str) -> DataFrame:
    numbered = ranked(best, [F.desc("affinity"), by], target="place")
    return numbered.withColumn("place", F.col("place") - 1)


def max_affinity(pairs: DataFrame, by: str = "a") -> DataFrame:
    """Best partner per row (``by="a"``) or column of a table of pairs; the lowest wins a tie.

    ``place`` orders the rows from the best to the worst match.
    """
    other = "b" if by == "a" else "a"
    best = pairs.groupBy(by).agg(
        F.max_by(other, F.struct("affinity", -F.col(other))).alias(other),
        F.max("affinity").alias("affinity"),
    )
    return _placed(best, by)


def assignment(scores: np.ndarray) -> np.ndarray:
    """Column for each row so that the total score is greatest.

    Shortest augmenting paths with potentials; needs rows <= columns.
    """
    cost = -np.asarray(scores, dtype=float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        best, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        back = np.zeros(m + 1, dtype=int)
        while owner[at]:
            seen[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = (slack < best[1:]) & ~seen[1:]
            best[1:][better], back[1:][better] = slack[better], at
            following = 1 + int(np.argmin(np.where(seen[1:], np.inf, best[1:])))
            step = best[following]
            u[owner[seen]] += step
            v[seen] -= step
            best[~seen] -= step
            at = following
        while at:
            owner[at], at = owner[back[at]], back[at]
    columns = np.empty(n, dtype=int)
    for column in range(1, m + 1):
        if owner[column]:
            columns[owner[column] - 1] = column - 1
    return columns


def optimal_matching(pairs: DataFrame, by: str = "a") -> DataFrame:
    """One-to-one partners with the greatest total affinity.

    The affinity table is small (components squared) and solved on the driver.
    With more rows than columns the surplus rows stay unmatched.
    """
    other = "b" if by == "a" else "a"
    table = pairs.select(by, other, "affinity").toPandas().pivot(index=by, columns=other, values="affinity")
    scores = table.to_numpy()
    if len(table.index) <= len(table.columns):
        found = [(i, j) for i, j in enumerate(assignment(scores))]
    else:
        found = [(i, j) for j, i in enumerate(assignment(scores.T))]
    rows = [(int(table.index[i]), int(table.columns[j]), float(scores[i, j])) for i, j in found]
    return pairs.sparkSession.createDataFrame(rows, f"{by} long, {other} long, affinity double")
