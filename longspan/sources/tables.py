"""Readers for the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from longspan.schema import conform


def table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def read_conformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read parquet and coerce it to a fixed schema."""
    return conform(spark.read.parquet(path), schema)


def write_clustered(df: DataFrame, path: str, *keys: str) -> None:
    """Write parquet whose files are sorted by ``keys``, for later pruning."""
    df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def peek(spark: SparkSession, path: str) -> T.StructType:
    """Schema only; parquet answers from the footer."""
    return spark.read.parquet(path).schema
