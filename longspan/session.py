"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A task's hash tables and sorts take some 100 to 200 bytes a row, but the files and shuffles it reads a few bytes only.
TASK_ROWS = 1_000_000
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


def local_session(cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("longspan")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master,
    where every task runs on this machine, may fall back on a new folder here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="longspan-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and read them back.

    Parquet, unlike a checkpoint's row files, keeps the columns prunable and tells
    the optimizer the true size, so small tables are broadcast from the start.
    The folders ``table-*`` are the cluster's to clean, like checkpoints.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows are dealt over; no fewer than the cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written meanwhile are made in tasks whose size does not grow with their inputs, the largest of ``rows`` rows.

    Map-side aggregates, skew splitting and the choice of joins stay Spark's.
    """
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), task_count(spark, rows))
    wanted = TASK_BYTES | {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(width)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
