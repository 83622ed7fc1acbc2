"""SQL scripts, results and named tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Quoted text, comments, statement ends, or any other character.
_TOKEN = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|.""", re.DOTALL
)


def split_statements(scripts: str | Iterable[str]) -> tuple[str, ...]:
    """Statements of one or more scripts, without comments and semicolons.

    Semicolons and dashes inside quotes stay; a last statement needs no
    semicolon.
    """
    found = []
    for script in [scripts] if isinstance(scripts, str) else scripts:
        current: list[str] = []
        for token in _TOKEN.findall(script) + [";"]:
            if token == ";":
                text = "\n".join(
                    line.rstrip() for line in "".join(current).split("\n") if line.strip()
                ).strip()
                if text:
                    found.append(text)
                current = []
            elif token.startswith("--") or token.startswith("/*"):
                current.append(" ")
            else:
                current.append(token)
    return tuple(found)


def run_scripts(spark: SparkSession, scripts: str | Iterable[str], args: dict | None = None) -> int:
    """Run statements in order; returns how many ran."""
    statements = split_statements(scripts)
    for statement in statements:
        spark.sql(statement, args=args or {})
    return len(statements)


def select_arrow(spark: SparkSession, query: str, path: str | None = None) -> pa.Table | DataFrame:
    """Result as one Arrow table; with ``path`` as parquet, written by the executors."""
    df = spark.sql(query)
    if path is None:
        return df.toArrow()
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def select_rows(spark: SparkSession, query: str, header: bool = True) -> tuple[tuple, list[tuple]]:
    """Column names and rows as tuples, for small results."""
    df = spark.sql(query)
    rows = [tuple(r) for r in df.collect()]
    names = tuple(df.columns)
    return (names, [names, *rows]) if header else (names, rows)


def table_name(stem: str, prefix: str = "") -> str:
    return f"{prefix}_{stem}" if prefix else stem


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def create_table_as(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> None:
    """Replace a table by a result; bucketed tables join without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
