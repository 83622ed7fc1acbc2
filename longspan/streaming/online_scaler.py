"""Online standardisation: running mean and variance over arriving batches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.stats import collect_stats, merge_stats
from longspan.schema import STATS
from longspan.session import checkpoint_dir

EPS = 1e-5


class OnlineScaler:
    """Running statistics per label, kept as a parquet table per version.

    Labels may be many, so all tasks write the rows, to a folder of their own beside the
    versions. A version is one small file that names it, so it is there whole or not at all.
    Each batch is aggregated on the executors and merged with the previous
    table; the variance is held at ``eps`` or more after every batch. A frozen
    scaler only applies. ``update`` fits ``foreachBatch``: a batch number seen
    before is not merged again, so a replayed batch does no harm.

    ``folder`` is where the versions are kept; a new object goes on from the last
    one there. Give a durable folder beside a stream's own checkpoint. Without
    one they lie in the session's checkpoint folder and end with the session.
    """

    def __init__(self, spark: SparkSession, name: str, eps: float = EPS, fill: float | None = None,
                 folder: str | None = None):
        self.spark = spark
        self.folder = f"{folder or checkpoint_dir(spark) + '/online'}/{name}"
        self.eps = eps
        self.fill = fill
        self.frozen = False
        self.version = self._last_version()

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}"

    def _last_version(self) -> int:
        """The highest version whose one file was committed, or -1."""
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        )
        try:
            paths = files.load(self.folder).select("path")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        number = F.regexp_extract("path", r"/v(\d{8,})/[^/]+$", 1)
        return paths.agg(F.coalesce(F.max(number.cast("int")), F.lit(-1))).first()[0]

    @property
    def stats(self) -> DataFrame:
        if self.version < 0:
            raise RuntimeError("the scaler has seen no batch")
        kept = self.spark.read.parquet(self._path(self.version))
        if kept.columns != ["rows"]:
            return kept  # an older version, which holds the rows themselves
        return self.spark.read.parquet(f"{self.folder}-rows/{kept.first()[0]}")

    def set_stats(self, stats: DataFrame, version: int = 0) -> None:
        held = stats.withColumn("variance", F.greatest("variance", F.lit(self.eps)))
        rows = uuid.uuid4().hex
        held.write.parquet(f"{self.folder}-rows/{rows}")
        self.spark.createDataFrame([(rows,)], "rows string").coalesce(1).write.mode("overwrite").parquet(self._path(version))
        self.version = version

    def reset(self) -> None:
        """Forget what was seen; later batches keep counting from here."""
        if self.version >= 0:
            self.set_stats(self.spark.createDataFrame([], STATS), self.version)

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Merge one batch of (label, value) rows."""
        number = self.version + 1 if batch_id is None else batch_id
        if self.frozen or number <= self.version:
            return
        fresh = collect_stats(batch)
        merged = fresh if self.version < 0 else merge_stats(self.stats, fresh)
        self.set_stats(merged, number)

    def apply(self, batch: DataFrame) -> DataFrame:
        """(value - mean) / sqrt(variance); gaps take the fill if there is one."""
        scaled = (F.col("value") - F.col("mean")) / F.sqrt("variance")
        known = self.stats.select("label", "mean", "variance")
        out = batch.join(known, "label", "left").withColumn("value", scaled).select(*batch.columns)
        if self.fill is None:
            return out
        usable = F.when(~F.isnan("value"), F.col("value"))
        return out.withColumn("value", F.coalesce(usable, F.lit(self.fill)))

    def forward(self, batch: DataFrame, training: bool = True) -> DataFrame:
        """Learn from a batch while training, then scale it."""
        if training:
            self.update(batch)
        return self.apply(batch)

    def attach(self, stream: DataFrame, checkpoint: str):
        """Update from a stream of (label, value) rows."""
        return (
            stream.writeStream.foreachBatch(lambda df, number: self.update(df, number))
            .option("checkpointLocation", checkpoint)
        )
