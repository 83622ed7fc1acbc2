"""Language of words, spans and documents.

Each word is scored by hashed letter trigrams under every language that its
script allows, and the best path through the words, where each switch of language
costs a penalty, labels spans of mixed text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import drawn, text_of, training_row

FIT_ROWS = 40_000
BUCKETS = 1 << 16
PENALTY = 6.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.001
BLOCK = 1 << 20
# Bytes of text whose words are held at once; a longer text is held alone.
SLICE_BYTES = 8 << 20
UNKNOWN = "und"
# First code points of the blocks of larger scripts (Unicode).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _letter_script() -> np.ndarray:
    """Per code point: 0 for what is not a letter, else 1 + the number of its script."""
    starts = np.array([start for start, _ in SCRIPTS])
    names = np.array([1 + SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    points = np.arange(sys.maxunicode + 1)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    return np.where(letter, names[np.searchsorted(starts, points, "right") - 1], 0).astype(np.uint8)


def _join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each after a 0, and where each text starts."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    joined = np.zeros(starts[-1] + 1, np.uint32)
    for start, part in zip(starts, parts, strict=False):
        joined[start + 1:start + 1 + len(part)] = part
    return joined, starts


def _trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters, the bucket of the trigram around each, and its script (from 1)."""
    script = _letter_script()[points]
    letters = np.where(script > 0, points, 0).astype(np.uint64)
    at = np.flatnonzero(script[1:-1]) + 1
    mixed = (letters[at - 1] * np.uint64(0x9E3779B1) + letters[at] * np.uint64(0x85EBCA77)
             + letters[at + 1] * np.uint64(0xC2B2AE3D))
    mixed ^= mixed >> np.uint64(15)
    mixed *= np.uint64(0x2545F4914F6CDD1D)
    return at, (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS, script[at].astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of all rows of a task; scripts are features after the buckets."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for row, language in enumerate(languages):
            points, _ = _join([texts[row].as_py()])
            _, bucket, script = _trigrams(points)
            found = np.bincount(np.concatenate((bucket, BUCKETS + script)), minlength=BUCKETS + len(SCRIPT_NAMES) + 1)
            totals[language] = totals.get(language, 0) + found
    for language, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": [language] * len(at), "feature": at, "n": counts[at]})


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Learn trigram and script counts from training rows with a language.

    Equal texts of a language are one. At most about ``fit_rows`` of the different
    texts, drawn by their hash, are counted; the driver gets at most one number per bucket and language. Without such rows
    the model knows no language and calls every text undetermined.
    """
    labelled = docs.where(training_row(id_column) & F.col(lang_column).isNotNull()).select(
        text_of(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    total = labelled.select(F.xxhash64("text").alias("hash"), "lang").distinct().count()
    counts = drawn(labelled, "text", total, fit_rows).distinct().mapInArrow(_count, "lang string, feature long, n long")
    rows = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES) + 1, len(languages)))
    for r in rows:
        table[r["feature"], languages.index(r["lang"])] = r["n"]
    grams, scripts = table[:BUCKETS] + SMOOTHING, table[BUCKETS:]
    scores = np.log(grams / grams.sum(0)) if languages else grams
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language has rules out none
    return Model(languages, scores.astype(np.float32), allowed)


def _word_scores(points: np.ndarray, starts: np.ndarray, model: Model):
    """Per word: scores by language, its text, and the positions of its first and last letter.

    Goes through the joined texts in blocks, so memory beside the code points is one block's.
    """
    scripts = _letter_script()
    is_letter = scripts[points] > 0
    first = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
    last = np.flatnonzero(is_letter[:-1] & ~is_letter[1:])
    scores = np.zeros((len(first), len(model.languages)), np.float32)
    for low in range(1, len(points) - 1, BLOCK):
        high = min(low + BLOCK, len(points) - 1)
        at, bucket, _ = _trigrams(points[low - 1:high + 1])
        if not len(at):
            continue
        word = np.searchsorted(first, at + (low - 1), "right") - 1
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        scores[word[new]] += np.add.reduceat(model.scores[bucket], new, axis=0)
    scores[~model.allowed[scripts[points[first]]]] -= 1e4
    return scores, np.searchsorted(starts, first, "right") - 1, first, last


def best_paths(scores: np.ndarray, text: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language of each word on the best path of its text; ties go to the earlier language and to staying."""
    path = np.zeros(len(scores), np.int32)
    if not len(scores):
        return path
    offsets = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    lengths = np.diff(np.concatenate((offsets, [len(text)])))
    order = np.argsort(-lengths, kind="stable")
    offsets, lengths = offsets[order], lengths[order]
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths[0]), "right")  # longer than t
    came = np.zeros((len(scores), scores.shape[1]), np.min_scalar_type(scores.shape[1]))
    best = scores[offsets].astype(np.float64)
    every = np.arange(scores.shape[1], dtype=np.int32)
    for t in range(1, lengths[0]):
        n = active[t]
        before, at = best[:n], offsets[:n] + t
        leader = before.argmax(1)
        other = before[np.arange(n), leader][:, None] - penalty
        stay = before >= other
        came[at] = np.where(stay, every, leader[:, None])
        best[:n] = np.where(stay, before, other) + scores[at]
    state = best.argmax(1).astype(np.int32)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        path[at] = state[:n]
        state[:n] = came[at, state[:n]] if t else state[:n]
    return path


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text."""
    for batch in batches:
        sizes = np.array([len(t.as_buffer()) for t in batch.column("text__")], np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
        for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=False):
            yield batch.slice(low, high - low)


def _identify(model: Model, penalty: float, spans: bool, kept: list[str]):
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in _slices(batches):
            n = batch.num_rows
            points, starts = _join(batch.column("text__").to_pylist())
            counts = np.zeros((n, k), np.int64)
            found: list[list[dict]] = [[] for _ in range(n)]
            if k:
                scores, text, first, last = _word_scores(points, starts, model)
                path = best_paths(scores, text, penalty)
                np.add.at(counts, (text, path), last - first + 1)
                if spans:
                    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (path[1:] != path[:-1])))) if len(text) else []
                    for i, j in zip(new, [*new[1:], len(text)], strict=True):
                        begin = starts[text[i]] + 1
                        found[text[i]].append({"start": int(first[i] - begin), "end": int(last[j - 1] - begin + 1), "lang": names[path[i]]})
            total = counts.sum(1)
            label = np.where(total > 0, counts.argmax(1) if k else 0, k)
            share = np.where(total > 0, counts.max(1, initial=0) / np.maximum(total, 1), 0.0)
            columns = {c: batch.column(c) for c in kept} | {"lang_pred": pa.array(names[label], pa.string()), "score": pa.array(share)}
            yield pa.RecordBatch.from_pydict(columns | ({"spans": pa.array(found, span_type)} if spans else {}))
    return identify


def identify(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", penalty: float = PENALTY,
    spans: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, lang_pred, score of every whole text, and on request its spans (start, end, lang) in code points.

    lang_pred is the language with most letters on the best path, score its share of
    all letters. Null, empty and letterless texts are ``und`` with score 0, and so
    is every text if the model knows no language. Offsets are those of the text in
    lower case, which a few special letters lengthen. Rows keep their number.
    ``keep`` names columns to carry along instead of the id.
    """
    if keep is None:
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text__"))
    else:
        rows = docs.select(*keep, text_of(text_column).alias("text__"))
    columns = [c for c in rows.columns if c != "text__"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text__")
    schema = f"{kept}, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<start:int,end:int,lang:string>>"
    return rows.mapInArrow(_identify(model, penalty, spans, columns), schema)
