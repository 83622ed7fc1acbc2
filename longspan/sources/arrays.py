"""Exchange with numpy and pickle files at the edge of a cluster.

These formats hold one process's memory, so they serve model inputs and small
exports. Tables stay in parquet.
"""

from __future__ import annotations

import gzip
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _open(path: str, mode: str):
    return gzip.open(path, mode) if str(path).endswith(".gz") else open(path, mode)


def to_npz(df: DataFrame, path: str, limit: int = 10_000_000) -> None:
    """One array per column; refuses tables beyond ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError("table too large for a single file; write parquet")
    table = df.toArrow()
    np.savez_compressed(path, **{c: table[c].to_numpy() for c in df.columns})


def from_npz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with np.load(path, allow_pickle=False) as data:
        frame = pd.DataFrame({f.name: data[f.name] for f in schema.fields})
    return spark.createDataFrame(frame, schema)


def array_header(path: str) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, column order flag and type of a .npy file, without its data."""
    with open(path, "rb") as file:
        version = np.lib.format.read_magic(file)
        read = {(1, 0): np.lib.format.read_array_header_1_0,
                (2, 0): np.lib.format.read_array_header_2_0}[version]
        return read(file)


def save_matrix(df: DataFrame, path: str, transpose: bool = False) -> None:
    """Feature rows in key order as a .npy matrix (for exports that fit a file)."""
    matrix = np.stack([np.array(r["features"]) for r in df.select("features").toLocalIterator()])
    np.save(path, matrix.T if transpose else matrix)


def load_matrix(spark: SparkSession, path: str, transpose: bool = False) -> DataFrame:
    matrix = np.load(path, mmap_mode="r")
    rows = matrix.T if transpose else matrix
    frame = pd.DataFrame({"obs_id": np.arange(len(rows)), "features": list(np.asarray(rows, dtype=float))})
    return spark.createDataFrame(frame, "obs_id long, features array<double>")


def write_records(records: Iterable, path: str) -> None:
    """A stream of pickled records; gzip by suffix."""
    with _open(path, "wb") as file:
        for record in records:
            pickle.dump(record, file, protocol=pickle.HIGHEST_PROTOCOL)


def read_records(path: str) -> Iterator:
    """Records of a pickle stream of one's own making (pickle runs code)."""
    with _open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def rows_to_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
