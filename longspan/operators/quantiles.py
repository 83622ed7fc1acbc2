"""Exact interpolated quantiles per key, safe for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.session import materialise

# Keys with more distinct values than this leave the in-memory aggregate.
DISTINCT_LIMIT = 200_000


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per (key, value), NULL included; a hot key spreads over its values.

    Written once, since it is far smaller than the rows and read several times.
    """
    return materialise(df.groupBy(*keys, value).agg(F.count("*").alias("n")))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: list[float],
    distinct_limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """One row per key with ``quantiles ARRAY<DOUBLE>`` in the given order."""
    return frequency_quantiles(frequencies(df, keys, value), keys, value, probabilities, distinct_limit)


def frequency_moments(freq: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, extremes and sample deviation per key from a frequency table.

    The deviation is summed around the mean, which is joined back, so large
    means do not cancel it. ``count`` includes rows without a value.
    """
    held = F.when(F.col(value).isNotNull(), F.col("n"))
    first = freq.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.sum(held).alias("__held"), (F.sum(held * F.col(value)) / F.sum(held)).alias("__mean"),
    )
    gap = F.col(value) - F.col("__mean")
    spread = freq.join(first.select(*keys, "__mean"), keys).groupBy(*keys).agg(
        F.sum(F.col("n") * gap * gap).alias("__spread")
    )
    deviation = F.sqrt(F.try_divide(F.col("__spread"), F.col("__held") - 1))
    return first.join(spread, keys).select(
        *keys, "count", "min_value", "max_value", deviation.alias("std_value")
    )


def frequency_quantiles(
    freq: DataFrame,
    keys: list[str],
    value: str,
    probabilities: list[float],
    distinct_limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """Quantiles from a frequency table.

    The built-in ``percentile`` keeps a map of one key's distinct values in one
    task. It serves keys up to ``distinct_limit`` distinct values; larger keys
    are resolved by :func:`_digit_quantiles`, whose state per key is bounded.
    """
    freq = freq.filter(F.col(value).isNotNull())
    width = freq.groupBy(*keys).agg(
        F.count("*").alias("__width"), F.sum("n").alias("__total")
    )
    wide = width.filter(F.col("__width") > distinct_limit)
    narrow, any_wide = freq, not wide.isEmpty()
    if any_wide:
        narrow = freq.join(wide.select(*keys), keys, "left_anti")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    small = narrow.groupBy(*keys).agg(
        F.percentile(F.col(value), wanted, F.col("n")).alias("quantiles")
    )
    if not any_wide:
        return small
    return small.unionByName(_digit_quantiles(freq, wide, keys, value, probabilities))


def _digit_quantiles(
    freq: DataFrame, wide: DataFrame, keys: list[str], value: str, probabilities: list[float]
) -> DataFrame:
    """Order statistics by descending through 16-bit digits of the value.

    The bits of a double, with the negatives flipped, sort like the number. In
    each of four rounds a histogram of the next digit (at most 65,536 bars per
    open prefix) tells which digit holds a wanted rank.
    """
    bits = F.expr(
        f"cast(java_method('java.lang.Double', 'doubleToLongBits', `{value}` + 0.0D) as bigint)"
    )
    flip = F.lit(0x7FFFFFFFFFFFFFFF)
    code = F.when(bits < 0, bits.bitwiseXOR(flip)).otherwise(bits)
    coded = freq.join(wide.select(*keys), keys).withColumn("__code", code)

    position = [F.lit(float(p)) * (F.col("__total") - 1) for p in probabilities]
    ranks = F.array_distinct(
        F.concat(
            F.array(*[F.floor(p).cast("long") for p in position]),
            F.array(*[F.ceil(p).cast("long") for p in position]),
        )
    )
    # Wanted ranks of one open prefix travel as one short array.
    rank_and_base = F.transform(
        ranks, lambda r: F.struct(r.alias("rank"), F.lit(0).cast("long").alias("base"))
    )
    open_ranks = wide.select(
        *keys, F.lit(0).cast("long").alias("__prefix"), rank_and_base.alias("__ranks")
    )
    for shift in (48, 32, 16, 0):
        parent = F.lit(0).cast("long") if shift == 48 else F.shiftright("__code", shift + 16)
        rising = Window.partitionBy(*keys, "__prefix").orderBy("__digit")
        upto = F.sum("__n").over(rising.rowsBetween(Window.unboundedPreceding, 0))
        bars = (
            coded.withColumn("__prefix", parent)
            .join(open_ranks, [*keys, "__prefix"])
            .groupBy(*keys, "__prefix", F.shiftright("__code", shift).alias("__digit"))
            .agg(F.sum("n").alias("__n"), F.min(value).alias("__value"),
                 F.first("__ranks").alias("__ranks"))
            .withColumn("__upto", upto)
        )
        before = F.col("__upto") - F.col("__n")
        held = F.filter(
            "__ranks",
            lambda r: (r["rank"] >= r["base"] + before) & (r["rank"] < r["base"] + F.col("__upto")),
        )
        open_ranks = bars.withColumn(
            "__ranks",
            F.transform(held, lambda r: F.struct(r["rank"].alias("rank"),
                                                 (r["base"] + before).alias("base"))),
        ).filter(F.size("__ranks") > 0).select(
            *keys, F.col("__digit").alias("__prefix"), "__ranks", "__value"
        )
        if shift:
            open_ranks = open_ranks.drop("__value")
    found = (
        open_ranks.select(*keys, "__value", F.explode("__ranks.rank").alias("__rank"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"))
    )
    answered = found.join(wide, keys)

    def interpolate(p):
        low = F.floor(p).cast("long")
        high = F.ceil(p).cast("long")
        below, above = F.element_at("__at", low), F.element_at("__at", high)
        # The weighting of the built-in aggregate, so both give the same bits.
        return F.when(below == above, below).otherwise((high - p) * below + (p - low) * above)

    return answered.select(*keys, F.array(*[interpolate(p) for p in position]).alias("quantiles"))

