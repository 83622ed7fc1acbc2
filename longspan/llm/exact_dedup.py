"""Exact duplicates by sorting contents.

Rows are range-partitioned by sampled splitters of their normalised text, sorted
inside the partitions (Spark's external sort), and equal neighbours, compared
over their whole text, form a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import WHITE_SPACE, stored, tasks, text_of

# A content with more than this share of all rows is dealt to several ranges,
# so at most so many contents are marked.
HOT_SHARE = 1000
LEAST_HOT = 1000


def normalised(column: str = "text", drop: str = WHITE_SPACE) -> Column:
    """The text without white space."""
    return reduce(lambda text, c: F.replace(text, F.lit(c), F.lit("")), drop, text_of(column))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    hot_share: int = HOT_SHARE, least_hot: int = LEAST_HOT,
) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    The longest original text (code points) stays, then the smallest id; a null
    id comes last. Null text counts as empty, so all empty and blank texts are
    one group. Rows repeated in all columns are separate members of a group and
    one of them stays. An empty table gives no rows; other columns are ignored.

    Splitters are (first 16 characters, hash of the whole text, salt), so they
    stay small however long the texts are. A text that holds more than one in
    ``hot_share`` of the rows gets salts and meets in several tasks; the leaders
    of these, at most 2 * hot_share rows, are then compared with each other.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        normalised(text_column).alias("norm"),
        F.char_length(text_of(text_column)).alias("points"),
    ).withColumn("hash", F.xxhash64("norm"))
    limit = max(least_hot, docs.count() // hot_share)
    # At most hot_share rows by the pigeonhole principle.
    hot = rows.groupBy("hash").count().where(F.col("count") > limit).select(
        "hash", F.ceil(F.col("count") / limit).alias("salts"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts"))
    placed = (
        rows.join(F.broadcast(hot), "hash", "left")
        .withColumn("salt", F.coalesce(salt, F.lit(-1)))
        .withColumn("head", F.substring("norm", 1, 16))
        .drop("salts")
        .repartitionByRange(tasks(docs.sparkSession), "head", "hash", "salt")
    )
    equal = Window.partitionBy("head", "hash", "salt", "norm")
    first = equal.orderBy(F.col("points").desc(), F.col("doc_id").asc_nulls_last())
    found = stored(placed.select(
        "doc_id", "points", "salt",
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("leader"),
        F.count(F.lit(1)).over(equal).alias("members"),
        F.sha2("norm", 256).alias("sha"),
    ))
    leaders = (
        found.where((F.col("salt") >= 0) & (F.col("place") == 1))
        .groupBy("sha")
        .agg(
            F.min(F.struct(
                (-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "salt",
            )).alias("best"),
            F.sum("members").alias("total"),
        )
    )
    joined = found.join(F.broadcast(leaders), "sha", "left")
    is_hot = F.col("best").isNotNull()
    return joined.select(
        "doc_id",
        F.when(is_hot, F.col("best.doc_id")).otherwise(F.col("leader")).alias("keep_id"),
        F.when(is_hot, F.col("total")).otherwise(F.col("members")).alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | (F.col("salt") == F.col("best.salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
