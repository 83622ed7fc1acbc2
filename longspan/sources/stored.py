"""Tables stored by person: bucketed and sorted, so that joins, windows and aggregates of a person move nothing.

``store`` keeps a result as a catalog table, ``by_person`` keeps the intermediate tables of curves,
as-of lookups and projection the same way. What is kept there are daily rows: a person with a
third of all events has at most one row per concept and day, so no bucket grows with the
events. Event tables of a person that hot are better left unbucketed.

Joins on (person, concept) also stay in place where ``spark.sql.requireAllClusterKeysForCoPartition`` is off.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from longspan.session import checkpoint_dir
from longspan.sources.statements import run_scripts

PERSON = "person_id"
# Sort keys of a bucket, as far as a table has them.
ORDER = ("person_id", "concept_id", "day", "datetime")


def _listed(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _order(df: DataFrame) -> list[str]:
    return [c for c in ORDER if c in df.columns]


def create_schema_at(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}` LOCATION '{folder}'")


def store(df: DataFrame, name: str, buckets: int, folder: str) -> DataFrame:
    """Replace the table ``name`` by the rows of ``df``, bucketed and sorted by person; returns it.

    One CREATE TABLE AS whose rows are placed by person first, so that a bucket is one
    file. ``folder`` must be new: a table may be replaced by a result that reads it.
    Files are plain. Sorted rows shrink to a small part of their size, and Spark would take
    the files' size for that of the rows and broadcast what should be joined in place.
    """
    spark = df.sparkSession
    placed, view = df.repartition(buckets, PERSON), f"stored_{uuid.uuid4().hex}"
    placed.createOrReplaceTempView(view)
    try:
        fresh = f"{name}_{uuid.uuid4().hex[:8]}"
        spark.sql(f"""CREATE TABLE {fresh} USING parquet
            OPTIONS ('compression' = 'uncompressed', 'parquet.enable.dictionary' = 'false') LOCATION '{folder}'
            CLUSTERED BY ({PERSON}) SORTED BY ({_listed(_order(df))}) INTO {buckets} BUCKETS AS SELECT * FROM {view}""")
        run_scripts(spark, f"DROP TABLE IF EXISTS {name}; ALTER TABLE {fresh} RENAME TO {name};")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(name)


def by_person(buckets: int) -> Callable[[DataFrame], DataFrame]:
    """A way to keep intermediate tables: in buckets of persons under the session's checkpoint folder."""
    def keep(df: DataFrame) -> DataFrame:
        name = f"table_{uuid.uuid4().hex}"
        return store(df, name, buckets, f"{checkpoint_dir(df.sparkSession)}/{name}")
    return keep


def drop_stored(spark: SparkSession, name: str) -> None:
    """Forget a table; its folder belongs to the caller."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
