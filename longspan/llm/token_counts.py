"""Token totals for every context limit from one exact length histogram."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of
from longspan.operators.running import running_total

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's pre-tokeniser splits text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTHS_PER_BUCKET = 4096


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(
    docs: DataFrame, text_column: str = "text", ranks: str = RANKS, pattern: str = PATTERN
) -> DataFrame:
    """Column n_tokens: the encoded length of each whole text; null and empty texts have 0.

    The vocabulary file must lie at ``ranks`` on every executor. Strings of
    special tokens are ordinary text.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select(text_of(text_column).alias("text")).mapInArrow(count, "n_tokens long")


def length_table(lengths: DataFrame, per_bucket: int = LENGTHS_PER_BUCKET, limits: tuple[int, ...] = ()) -> DataFrame:
    """One row per length that occurs or is one of ``limits``, with sums over this and all greater lengths.

    n_tokens, n_docs, docs_at_least, tokens_at_least, and for a context limit of
    n_tokens: tokens_truncated (total when longer documents are cut there),
    docs_cut, share_within (documents that fit), and percentiles: the whole percents
    whose quantile is this length, from counts. The histogram combines
    on the map side; lengths of neighbouring ``per_bucket`` values are summed
    together, so no task holds all lengths. No documents, no rows.
    """
    counted = stored(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    if limits:
        wanted = counted.sparkSession.createDataFrame([(int(x), 0) for x in sorted(set(limits))], counted.schema)
        counted = (counted if counted.isEmpty() else counted.unionByName(wanted)).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    histogram = counted.withColumns({
        "n_sum": F.col("n_tokens") * F.col("n_docs"),
        "down": -F.col("n_tokens"),
        "bucket": -F.floor(F.col("n_tokens") / per_bucket),
    })
    sums = running_total(histogram, "bucket", ["down"], {"docs_above": "n_docs", "tokens_above": "n_sum"})
    def percents(docs: Column) -> Column:
        """Whole percents of all documents that ``docs`` of them reach."""
        return F.floor(docs.cast("decimal(20,0)") * 100 / F.lit(all_docs)).cast("int")

    all_docs, all_tokens = histogram.agg(F.sum("n_docs"), F.sum("n_sum")).first()
    reached = percents(F.lit(all_docs) - F.col("docs_above"))
    below = percents(F.lit(all_docs) - F.col("docs_above") - F.col("n_docs"))
    return sums.select(
        "n_tokens", "n_docs",
        (F.col("docs_above") + F.col("n_docs")).alias("docs_at_least"),
        (F.col("tokens_above") + F.col("n_sum")).alias("tokens_at_least"),
        (F.lit(all_tokens) - F.col("tokens_above") + F.col("docs_above") * F.col("n_tokens")).alias("tokens_truncated"),
        F.col("docs_above").alias("docs_cut"),
        (1 - F.col("docs_above") / F.lit(all_docs)).alias("share_within"),
        F.when(reached > below, F.sequence(below + 1, reached)).otherwise(F.array().cast("array<int>")).alias("percentiles"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """Total tokens when every document is cut at a limit, for any limits (also absent lengths)."""
    reached = [
        F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"l{i}")
        for i, limit in enumerate(limits)
    ]
    one = table.agg(F.max("tokens_at_least").alias("total"), *reached)
    answers = F.array(*[
        F.struct(
            F.lit(limit).cast("long").alias("limit"),
            F.coalesce(
                F.col("total") - F.col(f"l{i}.tokens_at_least") + F.col(f"l{i}.docs_at_least") * limit,
                F.col("total"), F.lit(0)).alias("tokens"),
        ) for i, limit in enumerate(limits)
    ])
    return one.select(F.inline(answers))


def quantiles(table: DataFrame, probabilities: list[float]) -> DataFrame:
    """Smallest length within which at least the given share of documents fit.

    Counts are compared, not shares: p of n documents are ceil(p n) with p as it is
    written in decimals. Without documents the lengths are null.
    """
    n = table.agg(F.max("docs_at_least")).first()[0] or 0
    needed = [math.ceil(Decimal(str(p)) * n) for p in probabilities]
    within = F.lit(n) - F.col("docs_cut")
    one = table.agg(*[F.min(F.when(within >= need, F.col("n_tokens"))).alias(f"p{i}") for i, need in enumerate(needed)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("probability"), F.col(f"p{i}").alias("n_tokens")) for i, p in enumerate(probabilities)
    ])))
