"""Instance tables for training: batches, resamples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.evaluate import drawn_positions, numbered
from longspan.operators.running import bucket_count, ranked, running_total


def batches(df: DataFrame, key: str, size: int = 32, shuffle: bool = True, drop_last: bool = False,
            seed: int = 0) -> DataFrame:
    """Add ``batch``: consecutive runs of ``size`` rows in a shuffled order.

    The order is that of a seeded hash of the unique ``key`` (or the key
    itself), cut in even stretches of the hash range; every batch is full
    except possibly the last, which ``drop_last`` leaves out.
    """
    n = df.count()
    if not shuffle:
        placed = _in_order(df, key)
    else:
        spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 33)  # 31 bits
        rows = df.withColumns({"__h": spread, "__one": F.lit(1)}).withColumn(
            "__bucket", F.floor(F.col("__h") * bucket_count(n) / 2**31)
        )
        placed = running_total(rows, "__bucket", ["__h", key], {"position": "__one"}).drop(
            "__h", "__one", "__bucket"
        )
    out = placed.withColumn("batch", F.floor(F.col("position") / size)).drop("position")
    if drop_last:
        out = out.filter(F.col("batch") < n // size)
    return out


def _in_order(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Add ``position``, from 0, in the order of keys of any type, nulls first."""
    keys = [key] if isinstance(key, str) else list(key)
    return ranked(df, keys, target="position").withColumn("position", F.col("position") - 1)


def batch_count(n: int, size: int, drop_last: bool = False) -> int:
    return n // size if drop_last else -(-n // size)


def contiguous_parts(df: DataFrame, key: str | list[str], parts: int) -> DataFrame:
    """Add ``part``: ``parts`` near-equal runs of rows in the order of one or several keys of any type.

    Together the keys tell rows apart.
    """
    placed, n = _in_order(df, key), df.count()
    small, extra = divmod(n, parts)
    edge = extra * (small + 1)
    at = F.col("position")
    part = F.when(at < edge, F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - edge) / max(small, 1))
    )
    return placed.withColumn("part", part).drop("position")


def resample(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """int(fraction * n) rows drawn with replacement."""
    placed, n = numbered(df, key)
    draws = drawn_positions(df.sparkSession, n, int(fraction * n), seed, [0])
    copies = F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("copy")
    return placed.join(draws.select("position", "weight"), "position").select(*df.columns, copies)


def repeated(df: DataFrame, times: int = 1000) -> DataFrame:
    """Every row ``times`` times, numbered by ``repeat``."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def save_splits(splits: dict[str, DataFrame], path: str) -> None:
    """Write (features, label) tables under one folder, one directory per split."""
    merged = None
    for name, df in splits.items():
        part = df.select("features", "label", F.lit(name).alias("split"))
        merged = part if merged is None else merged.unionByName(part)
    merged.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    table = spark.read.parquet(path)
    names = [r["split"] for r in table.select("split").distinct().collect()]
    return {n: table.filter(F.col("split") == n).drop("split") for n in sorted(names)}


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its directory is read."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")
