"""Shared pieces of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.session import checkpoint_dir

# The six characters that count as white space.
WHITE_SPACE = " \t\n\x0b\f\r"
# A word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
# A key with more than one in HOT of all rows is hot, so fewer than HOT keys are.
HOT = 1_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder, read back as Parquet.

    Cuts the lineage, keeps columns prunable, and survives lost executors. The
    files lie in the folder of ``spark.checkpoint.dir`` and are the cluster's to
    clean, like checkpoints.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Number of partitions of a shuffle, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """Text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def training_row(column: str = "doc_id", parts: int = 4, held_out: int = 2) -> Column:
    """True for rows that models may learn from: crc32 of the id modulo 4 is not 2."""
    return ~held_out_row(column, parts, held_out)


def held_out_row(column: str = "doc_id", parts: int = 4, held_out: int = 2) -> Column:
    """A null id counts as the empty text."""
    identity = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(identity.cast("binary")) % parts == held_out


def drawn(docs: DataFrame, text: str, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``total`` different texts, with all their rows, by 63 bits of a hash of the text."""
    if total <= wanted:
        return docs
    return docs.where(F.shiftrightunsigned(F.xxhash64(text), 1) < F.lit((wanted << 63) // total))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """Inner join with a table that is unique in ``on``.

    The table's ``hot`` keys, at most 1,000 by their definition, are broadcast, so
    their many rows stay where they are; all others meet by shuffle.
    """
    few = table.where(hot)
    if few.isEmpty():
        return rows.join(table, on)
    few = F.broadcast(few)
    rest = rows.join(few.select(*on), on, "left_anti").join(table, on)
    return rows.join(few, on).unionByName(rest)
