"""Phrases whose words stand together more often than their parts suggest.

Every word starts a window of up to four words inside its piece. A shard's windows are
sorted and written as a weighted trie, an acyclic automaton whose states are
prefixes and whose weights are counts. The tries of all shards are cut at the same
prefixes and united range by range, weights added: a state's weight is then how
often its words stand in a row. Parts of phrases are looked up in the same counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import HOT, lookup, stored, text_of

MOST_WORDS = 4
MIN_COUNT = 30
COVERED = 80
TOP = 2_000
# Bytes of text in one shard's trie, windows in one range of prefixes.
SHARD_BYTES = 8_000_000
RANGE_WINDOWS = 500_000
# A trie of this many windows has fewer than 2**15 words, so its labels take two bytes.
TRIE_WINDOWS = 8_000
# Tries that leave a task at once, some 3 MB.
BATCH_TRIES = 16
SAMPLES_PER_RANGE = 16
# What ends a piece, what ends a word inside it; A-Z in lower case.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b" \t"
_LETTERS = bytes(range(65, 91))
_CLEAN = bytes.maketrans(PIECE_ENDS + WORD_ENDS + _LETTERS, b"\n" * len(PIECE_ENDS) + b"  " + _LETTERS.lower())

BLOCKS = pa.schema([
    ("range", pa.int64()), ("lang", pa.string()), ("words", pa.binary()),
    *[(f"label{i}", pa.list_(pa.int16())) for i in range(1, MOST_WORDS + 1)],
    *[(f"arcs{i}", pa.list_(pa.int16())) for i in range(1, MOST_WORDS)],
    ("weight", pa.list_(pa.int32())),
])
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])
_BLOCKS_DDL = "range long, lang string, words binary, " + ", ".join(
    [f"label{i} array<short>" for i in range(1, MOST_WORDS + 1)] + [f"arcs{i} array<short>" for i in range(1, MOST_WORDS)]
) + ", weight array<int>"
_COUNTS_DDL = "lang string, size int, phrase string, count long"


def slices(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """Cleaned text in slices of about ``size`` bytes, cut at the end of a piece where there is one.

    Inside a longer piece the last three words of a slice come again in the next; the
    flag says that no window of this slice starts at them.
    """
    start = 0
    while len(text) - start > size:
        cut = text.rfind(b"\n", start, start + size)
        if cut > start:
            yield text[start:cut], False
            start = cut
            continue
        reach = size
        while True:
            stop = min(len(text), start + reach)
            cut = max(text.rfind(b" ", start, stop), text.rfind(b"\n", start, stop))
            parts = text[start:cut].rsplit(None, MOST_WORDS - 1) if cut > start else []
            if len(parts) == MOST_WORDS or stop == len(text):
                break
            reach *= 2
        if len(parts) < MOST_WORDS:
            break
        yield text[start:cut], b"\n" not in parts[0]
        start += len(parts[0]) if b"\n" not in parts[0] else cut - start
    yield text[start:], False


def windows(parts: list[tuple[bytes, int, bool]], more: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Windows of cleaned slices (text, language number, open end).

    Gives the language and four ranks per window (0: the piece has ended), the sorted
    words, and the ranks of the words in ``more``. Ranks are places in byte order, from 1.
    """
    data = np.frombuffer(b"\n".join(text for text, _, _ in parts), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=inside[1:-1])
    inside[1:-1] &= data != 10
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])])
    del inside
    ids, order, rank = _ranks(pa.concat_arrays([words, pa.array(more, pa.binary())]))
    del words
    ranks, extra = rank[ids[:len(starts)]], rank[ids[len(starts):]]
    del ids
    # Places among the words: where pieces begin, and where parts do.
    piece = np.zeros(len(starts) + 1, np.int32)
    piece[np.searchsorted(starts, np.flatnonzero(data == 10).astype(np.int32))] = 1
    piece = np.cumsum(piece[:-1], dtype=np.int32)
    begins = np.searchsorted(starts, np.cumsum([0, *[len(text) + 1 for text, _, _ in parts]], dtype=np.int32))
    language = np.repeat(np.array([number for _, number, _ in parts], np.int32), np.diff(begins))
    del data, edges, starts, ends
    found = np.zeros((MOST_WORDS, len(ranks)), np.int32)
    for i in range(min(MOST_WORDS, len(ranks))):
        np.multiply(ranks[i:], piece[i:] == piece[:len(piece) - i], out=found[i, :len(ranks) - i])
    again = [begins[p + 1] - i for p, (_, _, opened) in enumerate(parts) if opened for i in range(1, MOST_WORDS)]
    if again:
        keep = np.ones(len(ranks), bool)
        keep[again] = False
        language, found = language[keep], found[:, keep]
    return language, found, order, extra


def _ranks(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word, the different words in byte order, and the place (from 1) of each number."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.indices.to_numpy(), coded.dictionary.take(order), rank


def _packed(columns: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Two sort keys of four columns, the weightier first."""
    columns, keys = iter(columns), []
    for left, right in zip(columns, columns):
        key = left.astype(np.uint64)
        key <<= np.uint64(32)
        key |= right.astype(np.uint32)
        keys.append(key)
    return keys


def _unpacked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The four columns of two sort keys."""
    return np.stack([part.astype(np.uint32).view(np.int32) for key in (high, low) for part in (key >> np.uint64(32), key)])


def _united(columns: Iterable[np.ndarray], weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort keys of the different windows in order, with the sum of their weights (1 each if there are none)."""
    high, low = _packed(columns)
    order = np.lexsort((low, high))
    high = high[order]
    low = low[order]
    changed = np.ones(len(order), bool)
    changed[1:] = high[1:] != high[:-1]
    changed[1:] |= low[1:] != low[:-1]
    first = np.flatnonzero(changed)
    if weights is None:
        summed = np.diff(np.append(first, len(order)))
    else:
        summed = np.add.reduceat(weights[order], first)
    del order
    high = high[first]
    low = low[first]
    return high, low, summed.astype(np.int64, copy=False)


def _states(columns: np.ndarray) -> list[np.ndarray]:
    """For each length of prefix, where its states begin among sorted windows."""
    changed = np.zeros(columns.shape[1], bool)
    changed[:1] = True
    found = []
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
        found.append(np.flatnonzero(changed))
    return found


def trie(columns: np.ndarray, weights: np.ndarray, words: pa.Array) -> dict:
    """The weighted trie of sorted windows: labels of the states by depth, arcs that leave each, weights of the leaves.

    Words are joined by line ends, which none holds.
    """
    used, labels = np.unique(columns, return_inverse=True)
    labels = labels.reshape(columns.shape) + int(used[0] != 0)
    states = _states(columns)
    row = {"words": b"\n".join(words.take(pa.array(used[used > 0] - 1)).to_pylist()), "weight": weights.astype(np.int32)}
    for i, at in enumerate(states):
        row[f"label{i + 1}"] = labels[i, at].astype(np.int16)
        if i:
            row[f"arcs{i}"] = np.diff(np.append(np.searchsorted(at, states[i - 1]), len(at))).astype(np.int16)
    return row


def _shard(parts: list[tuple[bytes, int, bool]], langs: list[str], splitters: list[tuple[str, tuple]]) -> Iterator[pa.RecordBatch]:
    """The trie of one shard, cut at the splitters, some tries at a time."""
    language, found, words, extra = windows(parts, [w for _, cut in splitters for w in cut])
    cuts = np.zeros((MOST_WORDS, len(splitters)), np.int32)
    at = 0
    for i, (_, cut) in enumerate(splitters):
        cuts[:len(cut), i] = extra[at:at + len(cut)]
        at += len(cut)
    rows = []
    for number in np.unique(language):
        of = language == number
        high, low, weights = _united((column[of] for column in found), None)
        name = langs[number]
        before = sum(lang < name for lang, _ in splitters)
        mine = [i for i, (lang, _) in enumerate(splitters) if lang == name]
        places = [0]
        for a, b in zip(*_packed(cuts[:, mine])):
            start, stop = np.searchsorted(high, a, "left"), np.searchsorted(high, a, "right")
            places.append(start + np.searchsorted(low[start:stop], b, "left"))
        places.append(len(weights))
        for i, (start, stop) in enumerate(zip(places, places[1:])):
            for at in range(start, stop, TRIE_WINDOWS):
                end = min(at + TRIE_WINDOWS, stop)
                rows.append({"range": before + i, "lang": name, **trie(_unpacked(high[at:end], low[at:end]), weights[at:end], words)})
                if len(rows) == BATCH_TRIES:
                    yield pa.RecordBatch.from_pylist(rows, BLOCKS)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, BLOCKS)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Slices of whole documents, gathered until they hold about ``size`` bytes."""
    parts, numbers, held = [], {}, 0
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang")):
            number = numbers.setdefault(lang.as_py(), len(numbers))
            for cut, opened in slices(text.as_py().translate(_CLEAN), size):
                if held and held + len(cut) > size:
                    yield parts, list(numbers)
                    parts, held = [], 0
                parts.append((cut, number, opened))
                held += len(cut) + 1
    if parts:
        yield parts, list(numbers)


def _sampled(docs: DataFrame, stride: int, size: int) -> list[tuple[str, tuple]]:
    """Every ``stride``-th window of some documents, as (language, words)."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, langs in _gathered(batches, size):
            language, found, words, _ = windows(parts)
            at = np.arange(min(stride // 2, len(language) - 1), len(language), stride) if len(language) else []
            yield pa.RecordBatch.from_pydict({
                "lang": [langs[language[i]] for i in at],
                "words": [[words[int(r) - 1].as_py() for r in found[:, i] if r] for i in at],
            }, pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary()))]))

    return [(r["lang"], tuple(bytes(w) for w in r["words"])) for r in docs.mapInArrow(pick, "lang string, words array<binary>").collect()]


def splitters(docs: DataFrame, range_windows: int = RANGE_WINDOWS, shard_bytes: int = SHARD_BYTES) -> list[tuple[str, tuple]]:
    """Windows that cut the corpus into ranges of about ``range_windows``, from a sample.

    They balance the work and do not touch results. There is one per ``range_windows``
    windows, some 30 bytes each, so raise that number with the memory of the workers.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = size // (6 * range_windows)
    if ranges < 1:
        return []
    wanted = SAMPLES_PER_RANGE * (ranges + 1)
    share = min(1.0, max(0.02, 60 * wanted / size))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = sorted(_sampled(sample, max(1, int(share * size / 6 / wanted)), shard_bytes))
    return sorted({found[len(found) * i // (ranges + 1)] for i in range(1, ranges + 1)}) if found else []


def _decoded(group: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Windows of all tries of a range, in ranks of their common words."""
    def column(name: str) -> tuple[np.ndarray, np.ndarray]:
        found = group.column(name).combine_chunks()
        found = found if isinstance(found, pa.ListArray) else found.chunk(0)
        return found.flatten(), found.value_lengths().to_numpy()

    words = pc.split_pattern(group.column("words").combine_chunks(), b"\n")
    bases = np.concatenate(([0], np.cumsum(words.value_lengths())[:-1]))
    ids, order, rank = _ranks(words.flatten())
    ranks = rank[ids]
    columns, weights = [], column("weight")[0].to_numpy().astype(np.int64)
    for i in range(1, MOST_WORDS + 1):
        labels, lengths = column(f"label{i}")
        labels = labels.to_numpy()
        at = np.repeat(bases, lengths) + labels.astype(np.int64) - 1
        columns.append(np.where(labels > 0, ranks[np.maximum(at, 0)], 0))
        if i < MOST_WORDS:
            arcs = column(f"arcs{i}")[0].to_numpy()
            columns = [np.repeat(c, arcs) for c in columns]
    return np.stack(columns), weights, order


def _union(group: pa.Table, least: int) -> pa.Table:
    """Add up the tries of a range; give the states that are frequent or may go on in a neighbouring range."""
    columns, weights, words = _decoded(group)
    high, low, weights = _united(columns, weights)
    columns = _unpacked(high, low)
    lang = group.column("lang")[0].as_py()
    rows = [{"lang": lang, "size": 0, "phrase": "", "count": int(weights.sum())}]
    for i, at in enumerate(_states(columns)):
        counts = np.add.reduceat(weights, at)
        wanted = counts >= least
        if i < MOST_WORDS - 1:
            wanted[[0, -1]] = True
        wanted &= columns[i, at] > 0
        chosen = columns[:i + 1, at[wanted]]
        spelled = [words.take(pa.array(c - 1)).to_pylist() for c in chosen]
        rows += [{"lang": lang, "size": i + 1, "phrase": b" ".join(parts).decode(), "count": int(count)}
                 for *parts, count in zip(*spelled, counts[wanted])]
    return pa.Table.from_pylist(rows, COUNTS)


def phrase_counts(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = MIN_COUNT,
    range_windows: int = RANGE_WINDOWS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """lang, size, phrase, count of all runs of up to four words that come ``least`` times or more; size 0: all words.

    Only A-Z are lower-cased. Null text is empty, a null language is und. Whole texts
    are read; those over ``shard_bytes`` in slices. Memory of a task is a shard or a range
    of prefixes; a frequent word, pair or triple spreads over as many ranges as it fills.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_of(text_column).alias("text"))
    cuts = splitters(rows, range_windows, shard_bytes)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, langs in _gathered(batches, shard_bytes):
            yield from _shard(parts, langs, cuts)

    tries = rows.mapInArrow(shards, _BLOCKS_DDL)
    states = tries.groupBy("range", "lang").applyInArrow(lambda group: _union(group, least), _COUNTS_DDL)
    return states.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("count")).where(
        (F.col("count") >= least) | (F.col("size") == 0))


def _part(first: str, last: str):
    return F.array_join(F.slice("words", F.expr(first), F.expr(last)), " ")


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = MIN_COUNT,
    covered: int = COVERED, top: int = TOP, range_windows: int = RANGE_WINDOWS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words comes a times, its parts l and r times at the cut with
    the least score, floor(2000000 a / (l + r)); the shorter first part wins ties. Phrases
    that stand in a longer one which comes at least ``covered`` % as often are left out.
    Order: score and a descending, then the phrase's bytes. No texts, no rows.
    """
    counts = stored(phrase_counts(docs, text_column, lang_column, least, range_windows, shard_bytes))
    frequent = counts.where("size > 0").drop("size")
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " ", -1))
    longer = phrases.where("size > 2").select(
        "lang", "count", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n")).select(
        "lang", "count", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("i"))
    around = longer.groupBy("lang", _part("i", "n").alias("phrase")).agg(F.max("count").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("count") * covered))
    cut = stored(kept.select(
        "lang", "phrase", F.col("count").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part("1", "k").alias("left"), _part("k + 1", "size(words) - k").alias("right")))
    total = cut.count()
    for part, name in (("left", "l"), ("right", "r")):
        used = cut.groupBy("lang", part).agg(F.count(F.lit(1)).alias("uses"))
        known = used.join(frequent.withColumnsRenamed({"phrase": part, "count": name}), ["lang", part])
        cut = lookup(cut, known, ["lang", part], F.col("uses") * HOT > F.lit(total)).drop("uses")
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(2000000 as {wide}) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("count").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
