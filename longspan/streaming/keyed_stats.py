"""Running statistics per label in the engine's state store.

Each task first shrinks its part of a batch to one row per label, so a label with
a third of all rows reaches its state as a few rows. The state is one merged row per label. It lies in
the stream's own checkpoint: a stream restarted from there goes on where the last
committed batch ended, a failed batch leaves no trace, and the statistics are
read back from the checkpoint without any other table.

Sessions need the RocksDB state store (``use_keyed_state``), which keeps large states off the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from longspan.schema import STATS, finite
from longspan.streaming.online_scaler import EPS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = T.StructType([f for f in STATS.fields if f.name != "label"])
STATE = "stats"
# Rows of a task that are shrunk together: 16 MB of labels and values.
PARTIAL_ROWS = 1 << 20


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _by_label(frame: pd.DataFrame) -> pd.DataFrame:
    """One row of statistics per label, from sums over sorted labels."""
    label, value = frame["label"].to_numpy(np.int64), frame["value"].to_numpy(np.float64)
    order = np.argsort(label, kind="stable")
    label, value = label[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    count = np.diff(np.append(start, len(label)))
    mean = np.add.reduceat(value, start) / count
    variance = np.add.reduceat((value - np.repeat(mean, count)) ** 2, start) / count
    return pd.DataFrame({
        "label": label[start], "count": count, "mean": mean, "variance": variance,
        "negative": np.add.reduceat((value < 0).astype(np.int64), start),
        "minval": np.minimum.reduceat(value, start), "maxval": np.maximum.reduceat(value, start)})[STATS.names]


def _partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per label and ``PARTIAL_ROWS`` rows of a task; values are finite."""
    held, rows = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            rows += len(frame)
        if rows >= PARTIAL_ROWS:
            yield _by_label(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if held:
        yield _by_label(pd.concat(held, ignore_index=True))


def merged(rows: list[tuple]) -> tuple:
    """Pooled (count, mean, variance, negative, minval, maxval), by deviations from the pooled mean."""
    count, mean, variance, negative, low, high = (np.array(c, dtype=float) for c in zip(*rows))
    n = count.sum()
    centre = mean[0] + (count * (mean - mean[0])).sum() / n
    spread = (count * (variance + (mean - centre) ** 2)).sum() / n
    return int(n), float(centre), float(spread), int(negative.sum()), float(low.min()), float(high.max())


class RunningStats(StatefulProcessor):
    """Merges partial rows of a label into its state once per batch; the variance is then held at ``eps`` or more."""

    def __init__(self, eps: float):
        self.eps = eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(STATE, HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = tuple(self.held.get()) if self.held.exists() else None
        for frame in rows:
            parts = list(frame[HELD.names].itertuples(index=False, name=None))
            total = merged(parts if total is None else [total, *parts])
        total = (*total[:2], max(total[2], self.eps), *total[3:])
        self.held.update(total)
        yield pd.DataFrame([(key[0], *total)], columns=STATS.names)

    def close(self) -> None:
        pass


def running_stats(stream: DataFrame, eps: float = EPS) -> DataFrame:
    """The changed statistics of every batch of (label, value) rows, for an ``update`` sink.

    Rows without a label and values that are NULL, NaN or infinite do not count; a label without
    any value has no state. The same statistics as ``OnlineScaler`` after each batch.
    """
    rows = stream.select(F.col("label").cast("long").alias("label"), finite(F.col("value").cast("double")).alias("value"))
    partial = rows.where("label IS NOT NULL AND value IS NOT NULL").mapInPandas(_partials, STATS)
    return partial.groupBy("label").transformWithStateInPandas(
        RunningStats(eps), STATS, outputMode="Update", timeMode="None")


def kept_stats(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The statistics that a stream's checkpoint holds, after its last committed batch."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select("key.label", "value.*").select(*STATS.names)


def standardised(batch: DataFrame, stats: DataFrame, fill: float | None = None) -> DataFrame:
    """(value - mean) / sqrt(variance) of a batch under kept statistics; gaps take the fill if there is one.

    Use it on a frozen table: read ``kept_stats`` once and apply it to any number of batches.
    """
    known = stats.select("label", "mean", "variance")
    scaled = finite((F.col("value") - F.col("mean")) / F.sqrt("variance"))
    shown = scaled if fill is None else F.coalesce(scaled, F.lit(fill))
    return batch.join(known, "label", "left").withColumn("value", shown).select(*batch.columns)
