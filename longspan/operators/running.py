"""Prefix sums over a whole table without a one-task window.

A window without PARTITION BY moves every row to one task. Here rows fall into
buckets and buckets into blocks: one window runs over the block totals, one over
the bucket totals of each block, and one inside each bucket. With 5e11 rows the
block totals are a few thousand numbers. Orders by value use the partitions of a range
shuffle as buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.session import materialise

BUCKET_ROWS = 50_000
BLOCK_BUCKETS = 4_096


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def hash_bucket(buckets: int, *columns: str) -> Column:
    """Spreads distinct keys evenly; use where any fixed order will do."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("long")


def range_bucket(df: DataFrame, order: list[Column | str], target: str = "bucket", partitions: int | None = None) -> DataFrame:
    """Monotone buckets of any sort keys: the partitions of a range shuffle, written once.

    ``order`` holds names or sort expressions of any type. Spark samples the cuts;
    writing keeps a lost executor or a second read from drawing them anew. Rows that
    are equal in all of ``order`` share a bucket, so end it with columns that tell
    rows apart.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(count, *order).withColumn(target, F.spark_partition_id().cast("long")))


def ranked(
    df: DataFrame, order: list[Column | str], by: tuple[str, ...] = (), target: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Add the 1-based row number in ``order`` within each ``by`` key, nulls being a key.

    No key meets in one task: rows are range-partitioned by key and order, numbered
    inside each partition, and moved on by the rows of the key in the partitions
    before. A partition continues at most one key, so those offsets are at most
    as many as partitions and are broadcast.
    """
    placed = range_bucket(df, [*by, *order], "__part", partitions)
    counts = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*(by or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__part").alias("__at"), *[F.col(c).alias(f"__k_{c}") for c in by],
        F.sum("__rows").over(earlier).alias("__before")).where("__before > 0")
    met = F.col("__part") == F.col("__at")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    numbered = placed.withColumn("__inside", inside).join(F.broadcast(offsets), met, "left")
    return numbered.withColumn(target, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long")).select(
        *df.columns, target)


def carried(
    df: DataFrame, by: tuple[str, ...], order: list[str], value: str, previous: str = "previous", following: str = "following",
    partitions: int | None = None,
) -> DataFrame:
    """Add the last value up to each row and the first from it on, nulls skipped, within each ``by`` key.

    Rows equal in ``order`` see each other's value; at most one of them has one. A
    scan in two levels: inside the parts of a range partition, and over one summary row
    per key and part. Only keys that go on over a cut need what other parts say; a
    part holds at most two of those, so that table is broadcast.
    """
    placed = range_bucket(df, [*by, *order], "__part", partitions)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    summary = placed.groupBy(*by, "__part").agg(
        F.max_by(value, place).alias("__last"), F.min_by(value, place).alias("__first"))
    key = by or (F.lit(0),)
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    known = summary.select(
        F.col("__part").alias("__at"), *[F.col(c).alias(f"__k_{c}") for c in by],
        F.last("__last", ignorenulls=True).over(earlier).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(later).alias("__later"),
    ).where(F.col("__earlier").isNotNull() | F.col("__later").isNotNull())
    met = F.col("__part") == F.col("__at")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    # Both directions are running frames; a frame to the end would be quadratic.
    inside = Window.partitionBy(*by, "__part")
    found = placed.withColumns({
        "__up": F.last(value, ignorenulls=True).over(inside.orderBy(*order)),
        "__down": F.last(value, ignorenulls=True).over(inside.orderBy(*[F.desc(c) for c in order])),
    }).join(F.broadcast(known), met, "left")
    return found.select(
        *df.columns, F.coalesce("__up", "__earlier").alias(previous), F.coalesce("__down", "__later").alias(following))


def running_total(
    df: DataFrame, bucket: str, order: list[str], amounts: dict[str, str], by: tuple[str, ...] = (),
    block_buckets: int = BLOCK_BUCKETS,
) -> DataFrame:
    """Add, per entry of ``amounts``, the sum of all rows that come before.

    Rows are ordered by (bucket, order) within each ``by`` key; ``order`` must
    be unique in a bucket. ``amounts`` maps a new column to a summed column.
    """
    keys = [*by, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(src).alias(f"__t_{dst}") for dst, src in amounts.items()])
    totals = totals.withColumn("__block", F.floor(F.col(bucket) / block_buckets))
    blocks = totals.groupBy(*by, "__block").agg(*[F.sum(f"__t_{dst}").alias(f"__b_{dst}") for dst in amounts])

    def ahead(within: tuple[str, ...], place: str, column: str) -> Column:
        window = Window.partitionBy(*(within or (F.lit(0),))).orderBy(place)
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    block_offsets = blocks.select(
        *by, "__block", *[ahead(by, "__block", f"__b_{dst}").alias(f"__p_{dst}") for dst in amounts])
    offsets = totals.join(block_offsets, [*by, "__block"]).select(*keys, *[
        (F.col(f"__p_{dst}") + ahead((*by, "__block"), bucket, f"__t_{dst}")).alias(f"__o_{dst}")
        for dst in amounts])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, keys)
    for dst, src in amounts.items():
        before = F.coalesce(F.sum(src).over(inside), F.lit(0))
        joined = joined.withColumn(dst, F.col(f"__o_{dst}") + before)
    return joined.drop(*[f"__o_{dst}" for dst in amounts])
