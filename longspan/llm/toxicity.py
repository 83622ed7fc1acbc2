"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on wording of toxic and of ordinary
documents. A window of a text that is much shorter under the first than under the
second speaks like the toxic ones; thresholds on these differences are
calibrated on labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import drawn, stored, text_of, training_row

FIT_ROWS = 20_000
LEVEL = 3
# The match finder leaves a window's last bytes alone, so every window gets a tail that both dictionaries know.
TAIL = b" ........"
STEPS = tuple(range(3, 11))
# Least z of a toxic word's class contrast: the best on the second half of the fit rows is taken.
CANDIDATES = (3.0, 5.0, 7.0, 10.0, 14.0, 20.0)
LEAST_WORDS, MOST_WORDS, ORDINARY_WORDS = 10, 2_000, 500
DICTIONARY_BYTES = 16_384
CACHED_WINDOWS = 500_000
_WORDS = re.compile(r"[^\W_]+")


def windows(text: str) -> list[bytes]:
    """One window per word of the whole text, in lower case."""
    return [b" " + w.encode() + TAIL for w in _WORDS.findall(text.lower())]


@dataclass
class Distance:
    """Difference of a window's compressed lengths; windows that come again are remembered."""

    ordinary: bytes
    toxic: bytes
    seen: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        settings = zstd.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
        self.compressors = [
            zstd.ZstdCompressor(
                dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=settings)
            for d in (self.ordinary, self.toxic)
        ]

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    def __setstate__(self, state):
        self.__init__(**state)

    def __call__(self, window: bytes) -> int:
        found = self.seen.get(window)
        if found is None:
            if len(self.seen) >= CACHED_WINDOWS:
                self.seen.clear()
            plain, toxic = self.compressors
            found = self.seen[window] = len(plain.compress(window)) - len(toxic.compress(window))
        return found

    def features(self, text: str) -> list[float]:
        """Two largest differences, how many windows reach each step, number of windows."""
        found = np.array([self(w) for w in windows(text)], np.int32)
        if not len(found):
            return [0.0] * (len(STEPS) + 3)
        top = np.sort(found)[::-1][:2]
        counts = [(found >= step).sum() for step in STEPS]
        return [float(top[0]), float(top[-1]), *np.log1p(counts), float(np.log1p(len(found)))]


def dictionary(words: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """The content of a dictionary: the words as windows, the most telling ones last, where matches cost least.

    zstandard's own trainer ranks substrings by frequency alone, so both classes
    would get the same common syllables; here the words' contrast decides.
    """
    return b"".join(b" " + w.encode() + TAIL for w in reversed(words))[-size:] or TAIL


def word_contrast(rows: DataFrame) -> DataFrame:
    """word, toxic and ordinary document counts, from rows (text, toxic); equal texts count once."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    one = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return (
        one.select("toxic", F.explode(words).alias("word")).where("word <> ''")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))
    )


def _dictionaries(counts: DataFrame, documents: tuple[int, int], candidates) -> list[Distance]:
    """Distances for each candidate, from the words whose share of documents differs most."""
    toxic, ordinary = (max(n, 1) for n in documents)
    share = (F.col("toxic") + F.col("ordinary") + 1) / (toxic + ordinary)
    z = (F.col("toxic") / toxic - F.col("ordinary") / ordinary) / F.sqrt(share * (1 / toxic + 1 / ordinary))
    scored = stored(counts.withColumn("z", z))
    marked = scored.where(F.col("toxic") >= 2).orderBy(F.col("z").desc(), "word").limit(MOST_WORDS).collect()
    common = scored.orderBy(F.col("ordinary").desc(), "word").limit(ORDINARY_WORDS + MOST_WORDS).collect()
    found = []
    for least in candidates:
        chosen = [r["word"] for i, r in enumerate(marked) if r["z"] >= least or i < LEAST_WORDS and r["z"] > 0]
        names = set(chosen)
        rest = [r["word"] for r in common if r["word"] not in names][:ORDINARY_WORDS]
        found.append(Distance(dictionary(rest), dictionary(chosen)))
    return found


@dataclass
class Model:
    distance: Distance
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str) -> float:
        x = (np.array(self.distance.features(text)) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _calibrated(distance: Distance, x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic weights of the features, by Newton steps with a small ridge."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - centre) / scale, np.ones(len(x))]
    weights = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, a.T @ (y - p) - weights)
    return Model(distance, centre, scale, weights)


def _ranking(scores: np.ndarray, y: np.ndarray) -> float:
    """Share of (toxic, ordinary) pairs in the right order."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(len(y))
    positive = int(y.sum())
    if not 0 < positive < len(y):
        return 0.5
    return (ranks[y == 1].mean() - (positive - 1) / 2) / (len(y) - positive)


def _features(rows: DataFrame, distances: list[Distance]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of (text, toxic) rows for each distance; the rows are bounded by the caller."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = [[v for d in distances for v in d.features(t)] for t in texts]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "values": pa.array(values, pa.list_(pa.float64()))})

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        measure, "toxic int, values array<double>").collect()
    y = np.array([r["toxic"] for r in found], float)
    x = np.array([r["values"] for r in found], float).reshape(len(found), len(distances), -1)
    return y, x


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", fit_rows: int = FIT_ROWS, candidates=CANDIDATES,
) -> Model | None:
    """Learn from the training rows that have a label 0 or 1.

    Equal texts are one, toxic if a row of theirs is. At most about ``fit_rows`` of
    the different texts, drawn by their hash, are used: words and features of these
    come to the driver, no texts. Without any labelled row of each class there is
    no model (None).
    """
    named = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).where(
        "toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(training_row(id_column)).select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    total = rows.select("id", F.xxhash64("text").alias("hash")).join(named, "id").select("hash").distinct().count()
    sample = stored(drawn(rows, "text", total, fit_rows).join(named, "id").groupBy("text").agg(F.max("toxic").alias("toxic")))
    by_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(by_class) < 2:
        return None
    choice = candidates[0]
    if len(candidates) > 1:
        half = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.lit(2))
        first, second = sample.where(half == 0), sample.where(half == 1)
        distances = _dictionaries(word_contrast(first), (by_class[1] // 2, by_class[0] // 2), candidates)
        y, x = _features(second, distances)
        ranks = [_ranked(d, x[:, i], y) for i, d in enumerate(distances)]
        choice = candidates[int(np.argmax(ranks))] * np.sqrt(2)  # twice the rows: z of the same contrast grows so
    [distance] = _dictionaries(word_contrast(sample), (by_class[1], by_class[0]), [choice])
    y, x = _features(sample, [distance])
    return _calibrated(distance, x[:, 0], y)


def _ranked(distance: Distance, x: np.ndarray, y: np.ndarray) -> float:
    if len(y) == 0:
        return 0.5
    model = _calibrated(distance, x, y)
    return _ranking(((x - model.centre) / model.scale) @ model.weights[:-1], y)


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts have no windows and get the calibrated score of that;
    without a model every score is 0. Rows keep their number; a null id is allowed.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) if model else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(measure, "doc_id long, score double")
