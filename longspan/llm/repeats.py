"""Repeated byte strings, by building the suffixes of many pieces column by column.

A window of 200 bytes belongs to the least hash of the 80-byte strings in it (its
anchor), so equal windows have equal anchors at equal places. Runs of windows of
one anchor are a piece of text. Pieces whose anchor comes once can't repeat. The
others meet by anchor, aligned at it, and their suffixes are ordered from right to
left: each round puts one byte in front of every piece's suffix, sorts stably by
that byte (the Burrows-Wheeler step), and updates the common prefixes of neighbours.
A window repeats where a neighbour shares 200 bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of

WINDOW = 200
ANCHOR = 80
STARTS = WINDOW - ANCHOR + 1
SEGMENT = 1 << 22
GROUP_PIECES = 4_000
HOT_PIECES = 50_000
_PAD = 256
_RANDOM = np.random.default_rng(7)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64((1 << 23) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"n": 0}


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows by one subtraction and product."""
    if _POWERS["n"] < len(data) + 1:
        n = 2 * len(data) + 2
        _POWERS.update(n=n, up=_powers(_BASE, n), down=_powers(_INVERSE, n))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _POWERS["down"][:len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces_of(data: bytes) -> tuple[np.ndarray, ...]:
    """start, windows, anchor's offset, anchor's hash and piece's hash of each run of windows."""
    found = [[] for _ in range(5)]
    for low in range(0, len(data) - WINDOW + 1, SEGMENT):
        part = np.frombuffer(data, np.uint8)[low:low + SEGMENT + WINDOW - 1]
        prefix = _prefix_hash(part)
        power = _POWERS["up"]
        grams = _mixed((prefix[ANCHOR:] - prefix[:-ANCHOR]) * power[:len(prefix) - ANCHOR])
        ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_least(ranked, STARTS) & _LOW).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        end = np.concatenate((start[1:], [len(anchor)]))
        at, n = anchor[start], end - start
        whole = (prefix[end + WINDOW - 1] - prefix[start]) * power[start]
        whole = _mixed(whole + (n * 1009 + (at - start)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        for out, values in zip(found, (start + low, n, at - start, grams[at].view(np.int64), whole.view(np.int64)), strict=True):
            out.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "n", "rel", "anchor", "piece"]
    for batch in batches:
        rows, columns = [], [[] for _ in names]
        texts = batch.column("data")
        for i in range(batch.num_rows):
            found = pieces_of(texts[i].as_py())
            rows.append(np.full(len(found[0]), i))
            for out, values in zip(columns, found, strict=True):
                out.append(values)
        at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        made = {c: pa.array(np.concatenate(v)) for c, v in zip(names, columns, strict=True)} if rows else {}
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(at), "text_hash": batch.column("text_hash").take(at)} | made)


_PIECES = "doc_id long, text_hash long, start long, n long, rel long, anchor long, piece long"


def repeated_windows(codes: np.ndarray, rel: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For aligned pieces: which windows (by place of the start) occur in another piece with the same code."""
    m, width = len(texts), STARTS - 1 + WINDOW
    table = np.full((m, width), _PAD, np.int64)
    for i, text in enumerate(texts):
        low = STARTS - 1 - rel[i]
        table[i, low:low + len(text)] = np.frombuffer(text, np.uint8)
    table += codes[:, None] * (_PAD + 1)
    hits = np.zeros((m, STARTS), bool)
    order = np.argsort(codes, kind="stable")
    common = np.zeros(m + 1, np.int64)  # of each suffix and the one before it; the last entry ends ranges
    for column in range(width - 1, -1, -1):
        key = table[order, column]
        new = np.argsort(key, kind="stable")
        sorted_key = key[new]
        pair = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % (_PAD + 1) != _PAD)) + 1
        after = np.zeros(m + 1, np.int64)
        if len(pair):
            p, q = new[pair - 1] + 1, new[pair] + 1
            after[pair] = 1 + np.minimum.reduceat(common, np.stack((p, q), 1).ravel())[::2]
        common, order = after, order[new]
        if column < STARTS:
            hits[order, column] = np.maximum(common[:-1], common[1:]) >= WINDOW
    return hits


def _group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("whole", ascending=False, kind="stable").drop_duplicates("piece")
    rel = group["rel"].to_numpy()
    codes = np.unique(group["anchor"].to_numpy(), return_inverse=True)[1]
    hits = repeated_windows(codes, rel, list(group["data"]))
    single = np.flatnonzero(~group["whole"].to_numpy() & hits.any(1))
    row, column = np.nonzero(hits[single])
    place = column - (STARTS - 1 - rel[single][row])
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)))) if len(row) else row
    last = np.concatenate((new[1:], [len(row)])) - 1 if len(row) else row
    start = group["start"].to_numpy()[single]
    docs = group[["doc_id", "text_hash"]].iloc[single[row[new]]]
    return pd.DataFrame({
        "doc_id": docs["doc_id"].to_numpy(), "text_hash": docs["text_hash"].to_numpy(),
        "low": start[row[new]] + place[new], "high": start[row[new]] + place[last] + WINDOW})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of pieces whose anchor is very common, as a digest."""
    for batch in batches:
        for row in batch.to_pylist():
            data = row["data"]
            digests = [hashlib.blake2b(data[i:i + WINDOW], digest_size=16).digest() for i in range(row["n"])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([row["doc_id"]] * row["n"], pa.int64()), "text_hash": [row["text_hash"]] * row["n"],
                "low": [row["start"] + i for i in range(row["n"])], "whole": [row["whole"]] * row["n"], "digest": digests})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, data, spans in zip(*(batch.column(c) for c in ("doc_id", "data", "spans")), strict=True):
            data, kept, at, removed, runs = data.as_py(), hashlib.sha256(), 0, 0, 0
            end = -1
            for low, high in sorted((s["low"], s["high"]) for s in spans.as_py() or ()):
                if low > end:
                    kept.update(data[at:low])
                    runs += 1
                    removed += high - low
                elif high > end:
                    removed += high - end
                end = at = max(end, high)
            kept.update(data[at:])
            rows.append((doc_id.as_py(), len(data), removed, runs, kept.hexdigest()))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_CUT.names, r, strict=True)) for r in rows], _CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string())])


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """Bytes left of each text without those in 200-byte strings that start twice or more.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, one row per
    input row. Null and short texts lose nothing. Rows repeated with id and text are
    copies of each other. Strings are judged on the input, so overlaps all count.

    Pieces with equal text are counted first (fixed-width counts, combined on the map
    side) and one of them represents all, so copies never meet in a task. Groups
    of a few anchors are ordered in memory, about ``GROUP_PIECES`` pieces each. An
    anchor with more than ``hot_pieces`` different pieces is settled by counting
    digests of its windows instead, which spreads over all tasks and is exact too.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).cast("binary").alias("data")).withColumn(
        "text_hash", F.xxhash64("data"))
    found = texts.select("doc_id", "text_hash", "data").mapInArrow(_anchors, _PIECES)
    again = found.groupBy("anchor").count().where("count > 1").select("anchor")
    kept = stored(found.join(again, "anchor", "left_semi"))
    identity = F.xxhash64("doc_id", "text_hash", "start")
    counted = kept.groupBy("piece").agg(F.count(F.lit(1)).alias("copies"), F.min(identity).alias("first"))
    marked = stored(kept.join(counted, "piece").select(
        *kept.columns, (F.col("copies") > 1).alias("whole"), (F.col("first") == identity).alias("chosen")))
    needed = marked.where("chosen")
    groups = max(1, -(-needed.count() // GROUP_PIECES))
    lists = needed.groupBy("doc_id", "text_hash").agg(F.collect_list(
        F.struct("start", "n", "rel", "anchor", "piece", "whole")).alias("list")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "list")
    pieces = texts.join(
        lists, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["text_hash"] == F.col("t"))
    ).select("doc_id", "text_hash", "data", F.inline("list")).withColumn(
        "data", F.substring(F.col("data"), (F.col("start") + 1).cast("int"), (F.col("n") + WINDOW - 1).cast("int")))
    hot = needed.groupBy("anchor").count().where(F.col("count") > hot_pieces).select("anchor")
    spans = marked.where("whole").select(
        "doc_id", "text_hash", F.col("start").alias("low"), (F.col("start") + F.col("n") + WINDOW - 1).alias("high"))
    cold = pieces
    if not hot.isEmpty():
        cold = pieces.join(hot, "anchor", "left_anti")
        every = pieces.join(hot, "anchor", "left_semi").dropDuplicates(["piece"]).select(
            "doc_id", "text_hash", "start", "n", "whole", "data").mapInArrow(
            _windows, "doc_id long, text_hash long, low long, whole boolean, digest binary")
        twice = every.groupBy("digest").count().where("count > 1").select("digest")
        spans = spans.union(every.where("not whole").join(twice, "digest", "left_semi").select(
            "doc_id", "text_hash", "low", (F.col("low") + WINDOW).alias("high")))
    ordered = cold.withColumn("group", F.pmod(F.col("anchor"), F.lit(groups))).groupBy("group").applyInPandas(
        _group, "doc_id long, text_hash long, low long, high long")
    per_text = spans.union(ordered).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("low", "high")).alias("spans")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spans")
    joined = texts.join(
        per_text, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["text_hash"] == F.col("t")), "left")
    return joined.select("doc_id", "data", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
