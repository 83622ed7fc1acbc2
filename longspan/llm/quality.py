"""Quality by a factorisation machine.

A document is a sparse vector: hashed words, statistics of its structure, and its
metadata, the numbers both as they are and as bins. The score is a logistic function of
weights and of all pairwise interactions, whose strengths are products of short
vectors; the sum over all pairs is half the square of sums less the sum of squares, so it takes
time linear in the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import drawn, stored, text_of, training_row

FIT_ROWS = 10_000
WORD_SLOTS = 1 << 14
FACTORS = 8
BINS = 8
EPOCHS, PATIENCE, BATCH_ROWS = 25, 4, 128
STEP, RIDGE = 0.08, 1e-5
# Bytes of text measured at once; longer documents are measured in slices and added up.
HELD_BYTES = 4_000_000
BLOCK_WORDS = 32
METADATA = ("n_chars",)
STATISTICS = 16
# Bytes by class. Others of ASCII are symbols; those from 0x80 on belong to letters.
_SPACE, _UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL = range(6)
_CLASS = np.full(256, _SYMBOL, np.int8)
_CLASS[128:] = _LOWER
_CLASS[list(b" \t\n\x0b\f\r")] = _SPACE
_CLASS[list(range(65, 91))] = _UPPER
_CLASS[list(range(97, 123))] = _LOWER
_CLASS[list(range(48, 58))] = _DIGIT
_CLASS[list(b".,;:!?'\"-()")] = _MARK


@dataclass
class Measured:
    """Word slots of documents (document, slot, count; sorted) and sums and maxima of their structure."""

    keys: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    worst: np.ndarray

    def __add__(self, other: Measured) -> Measured:
        keys, at = np.unique(np.concatenate((self.keys, other.keys)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((self.counts, other.counts)), len(keys))
        return Measured(keys, counts, self.sums + other.sums, np.maximum(self.worst, other.worst))


def _measure(texts: list[bytes]) -> Measured:
    n = len(texts)
    sums, worst = np.zeros((n, 10)), np.zeros((n, 3))
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    kinds = _CLASS[data]
    inside = kinds != _SPACE
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums[:, 0] = [len(t) for t in texts]
    lines = np.searchsorted(np.flatnonzero(data == 10), begins)
    sums[:, 1] = np.diff(np.append(lines, (data == 10).sum())) - (np.arange(n) < n - 1)
    if not len(starts):
        return Measured(np.zeros(0, np.int64), np.zeros(0), sums, worst)
    doc = np.searchsorted(begins, starts, "right") - 1
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)))
    held, kind = data[inside], kinds[inside]
    parts = {c: np.add.reduceat(kind == c, at[:-1]) for c in (_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL)}
    lower = np.where(kind == _UPPER, held + 32, held).astype(np.uint8)
    coded = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(lower.tobytes())]).dictionary_encode()
    ids = coded.indices.to_numpy()
    slots = np.array([xxhash.xxh32_intdigest(w.as_py()) % WORD_SLOTS for w in coded.dictionary], np.int64)[ids]
    keys, counts = np.unique(doc * WORD_SLOTS + slots, return_counts=True)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    flags = np.stack([
        parts[_SYMBOL] > 0, (parts[_UPPER] > 1) & (parts[_LOWER] == 0),
        ~first & np.concatenate(([False], ids[1:] == ids[:-1]))]).astype(np.int64)
    for i, c in enumerate((_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL)):
        sums[:, 2 + i] = np.bincount(doc, parts[c], n)
    for i in range(3):
        sums[:, 7 + i] = np.bincount(doc, flags[i], n)
    place = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    blocks = np.flatnonzero(place % BLOCK_WORDS == 0)
    sizes = np.diff(np.append(blocks, len(doc)))
    for i in range(3):
        share = np.add.reduceat(flags[i], blocks) / np.maximum(sizes, BLOCK_WORDS // 4)
        np.maximum.at(worst[:, i], doc[blocks], share)
    return Measured(keys, counts.astype(float), sums, worst)


def measured(texts: list[bytes]) -> Iterator[tuple[int, Measured]]:
    """(number of documents, measures) of whole texts in order, about HELD_BYTES at a time."""
    group, held = [], 0
    for text in texts:
        if len(text) > HELD_BYTES:
            if group:
                yield len(group), _measure(group)
            total, start = _measure([b""]), 0
            while start < len(text):
                cut = text.rfind(b" ", start, start + HELD_BYTES) if len(text) - start > HELD_BYTES else -1
                stop = cut if cut > start else start + HELD_BYTES
                total, start = total + _measure([text[start:stop]]), stop
            yield 1, total
            group, held = [], 0
            continue
        if group and held + len(text) > HELD_BYTES:
            yield len(group), _measure(group)
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield len(group), _measure(group)


def statistics(n: int, m: Measured) -> np.ndarray:
    """Structure statistics of n documents, one row each; without words mostly 0."""
    size, lines, upper, lower, digit, mark, symbol, odd, loud, again = m.sums.T
    doc = m.keys // WORD_SLOTS
    words = np.bincount(doc, m.counts, n)
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, m.counts)
    some = np.maximum(words, 1)
    return np.c_[
        np.log1p(size), np.log1p(words), size / some, upper / np.maximum(upper + lower, 1), symbol / np.maximum(size, 1),
        mark / some, digit / np.maximum(size, 1), lines / some, distinct / some, most / some, again / some, odd / some,
        loud / some, m.worst]


@dataclass
class Model:
    """Centre, scale and bins of the numbers; weights and factors of all slots."""

    centre: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    bias: float = 0.0
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return WORD_SLOTS + len(self.centre) * (1 + BINS)

    def vectors(self, n: int, keys: np.ndarray, counts: np.ndarray, numbers: np.ndarray):
        """Sparse rows: where each begins, slots, values. Words have length 1 together, numbers 1 each at most."""
        doc, slot = keys // WORD_SLOTS, keys % WORD_SLOTS
        value = np.log1p(counts)
        value = value / np.sqrt(np.maximum(np.bincount(doc, value**2, n), 1e-12))[doc]
        width = len(self.centre)
        scaled = np.clip((numbers - self.centre) / self.scale, -3, 3) / 3
        bins = (numbers[:, :, None] > self.cuts[None]).sum(2)
        dense = np.broadcast_to(WORD_SLOTS + np.arange(width), (n, width))
        binned = WORD_SLOTS + width + np.arange(width) * BINS + bins
        docs = np.concatenate((doc, np.repeat(np.arange(n), 2 * width)))
        order = np.argsort(docs, kind="stable")
        slots = np.concatenate((slot, np.c_[dense, binned].ravel()))[order]
        values = np.concatenate((value, np.c_[scaled, np.full((n, width), 0.5)].ravel()))[order]
        starts = np.searchsorted(docs[order], np.arange(n))
        return starts, slots, values.astype(np.float32)

    def logits(self, starts: np.ndarray, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each row and its sums of factor times value."""
        scaled = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat((scaled * scaled).sum(1), starts)
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def _rows(starts, slots, values, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen rows of a sparse matrix."""
    ends = np.append(starts[1:], len(slots))
    lengths = (ends - starts)[chosen]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.repeat(starts[chosen] - first, lengths) + np.arange(lengths.sum())
    return first, slots[at], values[at]


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _loss(model: Model, rows, y: np.ndarray) -> float:
    p = np.clip(_chance(model.logits(*rows)[0]), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _trained(model: Model, starts, slots, values, y: np.ndarray) -> Model:
    """Adaptive gradient steps on the logistic loss; the epoch that does best on every eighth row is kept."""
    random = np.random.default_rng(12)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate / (1 - rate)))
    model.weights = np.zeros(model.slots, np.float32)
    model.factors = random.normal(0, 0.05, (model.slots, FACTORS)).astype(np.float32)
    past_w, past_v, past_b = np.full(model.slots, 1e-6, np.float32), np.full(model.factors.shape, 1e-6, np.float32), 1e-6
    number = np.arange(len(y))
    held = number[number % 8 == 7] if len(y) >= 64 else number
    used = number[number % 8 != 7] if len(y) >= 64 else number
    checked = _rows(starts, slots, values, held)
    best, kept, since = np.inf, None, 0
    for _ in range(EPOCHS):
        for chosen in np.array_split(random.permutation(used), max(1, len(used) // BATCH_ROWS)):
            first, s, v = _rows(starts, slots, values, chosen)
            logits, sums = model.logits(first, s, v)
            gap = (_chance(logits) - y[chosen]) / len(chosen)
            lengths = np.diff(np.append(first, len(s)))
            each = np.repeat(gap, lengths).astype(np.float32) * v
            mine = np.repeat(sums, lengths, axis=0)
            order = np.argsort(s, kind="stable")
            found, at = np.unique(s[order], return_index=True)
            slope_w = np.add.reduceat(each[order], at) + RIDGE * model.weights[found]
            slope_v = np.add.reduceat((each[:, None] * (mine - model.factors[s] * v[:, None]))[order], at) + RIDGE * model.factors[found]
            past_w[found] += slope_w**2
            past_v[found] += slope_v**2
            past_b += float(gap.sum()) ** 2
            model.weights[found] -= STEP * slope_w / np.sqrt(past_w[found])
            model.factors[found] -= STEP / 2 * slope_v / np.sqrt(past_v[found])
            model.bias -= STEP * float(gap.sum()) / np.sqrt(past_b)
        now = _loss(model, checked, y[held])
        if now < best - 1e-5:
            best, kept, since = now, (model.bias, model.weights.copy(), model.factors.copy()), 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    model.bias, model.weights, model.factors = kept
    return model


def _metadata(docs: DataFrame, columns: tuple[str, ...]) -> list:
    """One array of numbers; a column that is null or absent gives null."""
    present = {c.lower() for c in docs.columns}
    return [F.array(*[F.col(c).cast("double") if c.lower() in present else F.lit(None).cast("double") for c in columns])
            if columns else F.array().cast("array<double>")]


def _numbers(n: int, m: Measured, metadata: list[list[float | None]]) -> np.ndarray:
    """Statistics, then log(1 + number) and a flag of absence for each metadata column."""
    given = np.array(metadata, float).reshape(n, -1)
    known = np.isfinite(given)
    return np.c_[statistics(n, m), np.log1p(np.maximum(np.where(known, given, 0), 0)), ~known]


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", metadata: tuple[str, ...] = METADATA, fit_rows: int = FIT_ROWS,
    parts: int = 3, held_out: int = 1,
) -> Model | float:
    """Learn from the training rows that have a label 0 or 1.

    Equal texts are one, good if at least half of their labels are. About ``fit_rows`` of
    the different texts at most, drawn by their hash, are used: their sparse vectors come to
    the driver, no texts. Metadata columns are numbers. Without a row of each class the
    result is the share of label 1 (0.5 without any row), which is then every score.
    """
    named = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("y in (0, 1)")
    [extra] = _metadata(docs, metadata)
    rows = docs.where(training_row(id_column, parts, held_out)).select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"), extra.alias("extra"))
    total = rows.select("id", F.xxhash64("text").alias("hash")).join(named.select("id"), "id", "left_semi").select(
        "hash").distinct().count()
    sample = stored(drawn(rows, "text", total, fit_rows).join(named, "id").groupBy("text").agg(
        (F.avg("y") >= 0.5).cast("int").alias("y"), F.min("extra").alias("extra")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            y, extras = batch.column("y").to_pylist(), batch.column("extra").to_pylist()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for n, m in measured(texts):
                starts = np.searchsorted(m.keys, np.arange(n + 1) * WORD_SLOTS)
                yield pa.RecordBatch.from_pydict({
                    "key": [xxhash.xxh64_intdigest(t) >> 1 for t in texts[at:at + n]],
                    "y": pa.array(y[at:at + n], pa.int32()),
                    "slots": pa.ListArray.from_arrays(starts.astype(np.int32), (m.keys % WORD_SLOTS).astype(np.int32)),
                    "counts": pa.ListArray.from_arrays(starts.astype(np.int32), m.counts.astype(np.float32)),
                    "numbers": pa.array(list(_numbers(n, m, extras[at:at + n])), pa.list_(pa.float64())),
                })
                at += n

    found = sample.mapInArrow(vectors, "key long, y int, slots array<int>, counts array<float>, numbers array<double>").toArrow()
    found = found.sort_by("key").combine_chunks()
    y = found.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    numbers = np.array(found.column("numbers").to_pylist())
    slots, counts = (found.column(c).combine_chunks() for c in ("slots", "counts"))
    doc = np.repeat(np.arange(len(y)), slots.value_lengths().to_numpy())
    cuts = np.quantile(numbers, np.arange(1, BINS) / BINS, axis=0).T
    model = Model(numbers.mean(0), numbers.std(0) + 1e-9, cuts)
    rows = model.vectors(len(y), doc * WORD_SLOTS + slots.flatten().to_numpy(), counts.flatten().to_numpy().astype(float), numbers)
    return _trained(model, *rows, y)


def score(
    docs: DataFrame, model: Model | float, id_column: str = "doc_id", text_column: str = "text",
    metadata: tuple[str, ...] = METADATA,
) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text.

    Null and empty texts have no words; their score comes from their numbers. Every row
    gives one row, null and repeated ids included; other columns do not matter.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            if not isinstance(model, Model):
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), model))], ["doc_id", "score"])
                continue
            extras = batch.column("extra").to_pylist()
            for n, m in measured([t.as_py().encode() for t in batch.column("text")]):
                rows = model.vectors(n, m.keys, m.counts, _numbers(n, m, extras[at:at + n]))
                chance = _chance(model.logits(*rows)[0]).astype(float)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(chance)], ["doc_id", "score"])
                at += n

    [extra] = _metadata(docs, metadata)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), extra.alias("extra"))
    return rows.mapInArrow(measure, "doc_id long, score double")
