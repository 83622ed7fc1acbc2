"""Mergeable descriptive statistics per label (population variance)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.schema import STATS, finite
from longspan.session import materialise


def _summary(v: str) -> list[Column]:
    return [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
        F.count_if(F.col(v) < 0).alias("negative"),
        F.min(v).alias("minval"),
        F.max(v).alias("maxval"),
    ]


def collect_stats(
    data: DataFrame, label: str = "label", value: str = "value", labels: DataFrame | None = None
) -> DataFrame:
    """Count, mean, variance, negatives, minimum and maximum per label.

    Values that are NULL, NaN or infinite do not count. Labels without any
    value are dropped unless ``labels`` lists the labels to keep.
    """
    usable = finite(F.col(value).cast("double"))
    rows = data.select(F.col(label).alias("label"), usable.alias("v")).filter(F.col("v").isNotNull())
    stats = rows.groupBy("label").agg(*_summary("v"))
    if labels is None:
        return stats
    kept = labels.select("label").distinct().join(stats, "label", "left")
    return kept.fillna(0, ["count", "negative"])


def _logarithm(value: Column) -> Column:
    return F.when(value > 0, F.log10(value))


def log10_stats(data: DataFrame, label: str = "label", value: str = "value", **options) -> DataFrame:
    """The same statistics of the logarithms; values without one do not count."""
    logged = data.select(label, _logarithm(F.col(value)).alias(value))
    return collect_stats(logged, label, value, **options)


def collect_with_log10(
    data: DataFrame, label: str = "label", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Plain and log10 statistics in one pass over the data.

    The result has one row per label and is written once, since both halves
    are read several times.
    """
    usable = finite(F.col(value).cast("double"))
    rows = data.select(F.col(label).alias("label"), usable.alias("v")).withColumn(
        "l", _logarithm(F.col("v"))
    )
    plain = [c.alias(f"v_{n}") for c, n in zip(_summary("v"), STATS.names[1:])]
    logged = [c.alias(f"l_{n}") for c, n in zip(_summary("l"), STATS.names[1:])]
    both = materialise(rows.groupBy("label").agg(*plain, *logged))

    def half(prefix: str) -> DataFrame:
        return both.filter(F.col(f"{prefix}_count") > 0).select(
            "label", *[F.col(f"{prefix}_{n}").alias(n) for n in STATS.names[1:]]
        )

    return half("v"), half("l")


def pool_partials(partials: DataFrame, *keys: str) -> DataFrame:
    """Combine partial statistics per key.

    The variance uses deviations from the pooled mean, which a second small
    aggregate joins back; subtracting squares of large means would cancel.
    """
    n = F.col("count")
    # An empty partial carries no mean; its product must not poison the sum.
    weighted = F.when(n > 0, n * F.col("mean"))
    totals = partials.groupBy(*keys).agg(
        F.sum("count").alias("__n"), (F.sum(weighted) / F.nullif(F.sum("count"), F.lit(0))).alias("__mean")
    )
    shift = F.col("mean") - F.col("__mean")
    spread = F.when(n > 0, n * (F.col("variance") + shift * shift))
    return (
        partials.join(totals, list(keys))
        .groupBy(*keys)
        .agg(
            F.max("__n").alias("count"),
            F.max("__mean").alias("mean"),
            (F.sum(spread) / F.nullif(F.max("__n"), F.lit(0))).alias("variance"),
            F.sum("negative").alias("negative"),
            F.min("minval").alias("minval"),
            F.max("maxval").alias("maxval"),
        )
    )


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of the concatenated data; labels are the union."""
    names = STATS.names
    merged = reduce(lambda a, b: a.unionByName(b), [p.select(*names) for p in parts])
    return pool_partials(merged, "label")


def padding_count(size: Column) -> Column:
    """Values missing to ``size``; raises where there are more already."""
    pad = (size - F.col("count")).cast("long")
    too_many = F.raise_error(F.lit("statistics cannot be filled to fewer values than they have"))
    return F.when(pad < 0, too_many.cast("long")).otherwise(pad)


def extend_stats(
    stats: DataFrame, count: int | Column, fill: float | Column = 0.0, labels: DataFrame | None = None
) -> DataFrame:
    """As if the labels' data had been padded to ``count`` values of ``fill``.

    Minimum and maximum take in the fill even when nothing is padded. Labels
    that already have more than ``count`` values raise.
    """
    chosen = stats if labels is None else stats.join(labels.select("label"), "label", "left_semi")
    size = count if isinstance(count, Column) else F.lit(count)
    value = (fill if isinstance(fill, Column) else F.lit(float(fill))).cast("double")
    pad = padding_count(size)
    padding = chosen.select(
        "label",
        pad.alias("count"),
        value.alias("mean"),
        F.lit(0.0).alias("variance"),
        F.when(value < 0, pad).otherwise(F.lit(0)).cast("long").alias("negative"),
        value.alias("minval"),
        value.alias("maxval"),
    )
    return merge_stats(stats, padding)


def pool_stats(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Give each label of a group the joint statistics of its group.

    ``groups`` is (label, group); labels outside keep their own statistics.
    """
    tagged = stats.join(groups.select("label", F.col("group")), "label", "left")
    grouped = tagged.filter(F.col("group").isNotNull())
    joint = pool_partials(grouped.drop("label"), "group")
    shared = grouped.select("label", "group").join(joint, "group").select(*STATS.names)
    return tagged.filter(F.col("group").isNull()).select(*STATS.names).unionByName(shared)


def pool_all(stats: DataFrame) -> DataFrame:
    """Give every label the joint statistics of all labels."""
    return pool_stats(stats, stats.select("label", F.lit("all").alias("group")))


def labels_with_gaps(stats: DataFrame) -> DataFrame:
    """Labels whose statistics are not all known."""
    known = reduce(
        lambda a, b: a & b, [F.col(c).isNotNull() for c in ("mean", "variance", "minval", "maxval")]
    )
    return stats.filter(~known).select("label")


def wide_to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.unpivot(key, columns, "label", "value")


def long_to_wide(df: DataFrame, key: str, labels: list) -> DataFrame:
    """Pivot with the given labels, so no extra job looks for them.

    One aggregate by key that holds a place per label. Spark's own pivot groups by key and label
    first: one more shuffle, and a row per key and label in the memory of a task.
    """
    def first(label) -> Column:
        return F.first(F.when(F.col("label").eqNullSafe(F.lit(label)), F.col("value")), ignorenulls=True)

    return df.groupBy(key).agg(*[first(x).alias(str(x)) for x in labels])
