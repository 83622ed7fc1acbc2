"""Jaccard join of word shingles, with Bayesian pruning of candidates.

Texts that share a band of MinHash values are candidates. Their values are compared
a step at a time; a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a tolerance. The rest is verified on
the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of
from longspan.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 24
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(20240229)
_FACTORS = _DRAWN.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the runs of ``width`` words; fewer words are one run, no words none."""
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in text.split(" ") if w], np.uint64)
    if not len(hashed):
        return hashed
    n = max(1, len(hashed) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(hashed))):
        mixed = mixed * _BASE + hashed[i:i + n]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set, as 32 bits."""
    found = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for low in range(0, len(hashes), 2048):
        block = hashes[low:low + 2048]
        found = np.minimum(found, ((block * _FACTORS[:, None] + _TERMS[:, None]) >> np.uint64(32)).min(1))
    return found


def band_hashes(values: np.ndarray) -> np.ndarray:
    bands = values.reshape(BANDS, ROWS)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        mixed = (mixed + bands[:, i]) * _BASE
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, matches a pair needs to go on), for a uniform prior of the similarity."""
    s = np.linspace(0, 1, 20_001)
    needs = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            density = s**m * (1 - s) ** (n - m)
            if density[s >= threshold].sum() >= tolerance * density.sum():
                break
        needs.append((n, m))
    return tuple(needs)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(i, [j ...]) for linked texts i of ``left`` and j of ``right``; if ``same``, each pair once."""
    values = np.stack([minhash(s) for s in sets])
    bands = np.stack([band_hashes(v) for v in values])
    joined, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(len(joined), bool)
    for i in left:
        others = right[right > i] if same else right
        others = others[(bands[others] == bands[i]).any(1)]
        for n, least in least_matches():
            if not len(others):
                break
            others = others[(values[others, :n] == values[i, :n]).sum(1) >= least]
        if not len(others):
            continue
        marked[number[starts[i]:starts[i + 1]]] = True
        shared = np.array([marked[number[starts[j]:starts[j + 1]]].sum() for j in others])
        marked[number[starts[i]:starts[i + 1]]] = False
        # exact: shared / union >= threshold
        ok = shared >= THRESHOLD * (sizes[i] + sizes[others] - shared) - 1e-9
        if ok.any():
            yield i, others[ok]


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Per text of two blocks: how many links it has, and one linked text of each local component."""
    sets = [shingles(t) for t in group["words"]]
    index = np.arange(len(sets))
    same = group["low"].iloc[0] == group["high"].iloc[0]
    low = (group["block"] == group["low"]).to_numpy()
    counts, parent = np.zeros(len(sets), np.int64), index.copy()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, others in links(sets, index if same else index[low], index if same else index[~low], same):
        counts[i] += len(others)
        counts[others] += 1
        for j in others:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    digests = group["digest"].to_numpy()
    found = [(digests[i], digests[root(i)], counts[i]) for i in index if counts[i]]
    return pd.DataFrame(found, columns=["digest", "peer", "links"])


def normal(column: str) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " "))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("words")]
        bands = [band_hashes(minhash(s)) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "digest", "bands"])


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per document: its group of near copies and its number of links.

    doc_id; digest of its words; text_id, the least id with the same words;
    n_links, how many other texts (different words) have a similarity of 0.8 or more
    in runs of five words; class_id, the least id that links lead to; leader, true for the
    rows of the least (id, digest) of that group. Nulls come last in order. Texts of fewer
    than five words are one run; null, empty and blank texts have no run and no link and
    are copies of each other. Rows repeated with id and text count as one text.

    Equal texts are one text from the start. Texts in a band's bucket are linked to its
    least one, so buckets give edges in proportion to their size, and components of those
    hold all candidates. A component is compared in pairs of blocks of about ``block``
    texts, each pair of blocks a group of its own; it gives counts and local components,
    never pairs.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), normal(text_column).alias("words")).withColumn(
        "digest", F.md5("words"))
    sketches = stored(rows.mapInArrow(_sketch, "doc_id long, digest string, bands array<long>"))
    texts = stored(sketches.groupBy("digest").agg(F.min("doc_id").alias("text_id")))
    entries = sketches.select(F.xxhash64("digest").alias("a"), F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("a").alias("b"), F.max("a").alias("c")).where("b <> c")
    found = components(entries.join(buckets, "bucket").select("a", "b"))
    members = texts.withColumn("node", F.xxhash64("digest")).join(found, "node")
    blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").select(
        "text_id", "digest", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    wanted = rows.join(
        placed.withColumnRenamed("digest", "d"),
        rows["digest"].eqNullSafe(F.col("d")) & rows["doc_id"].eqNullSafe(F.col("text_id")),
    ).dropDuplicates(["digest"])
    paired = wanted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", "digest", "words", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    linked = stored(paired.groupBy("root", "low", "high").applyInPandas(
        _linked, "digest string, peer string, links long"))
    counts = linked.groupBy("digest").agg(F.sum("links").alias("n_links"))
    groups = components(linked.select(F.col("digest").alias("a"), F.col("peer").alias("b")))
    named = texts.join(counts, "digest", "left").join(groups.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "digest").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(
        F.col("text_id").isNull().alias("none"), "text_id", "digest")).alias("best"))
    full = named.join(best, "root").select("digest", "text_id", "n_links", "best")
    return sketches.select("doc_id", "digest").join(full, "digest").select(
        "doc_id", "digest", "text_id", "n_links", F.col("best.text_id").alias("class_id"),
        ((F.col("digest") == F.col("best.digest")) & F.col("doc_id").eqNullSafe(F.col("best.text_id"))).alias("leader"))
