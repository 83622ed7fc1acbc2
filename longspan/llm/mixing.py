"""Mixing sources to target weights, in whole epochs and one exact cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of, word_count
from longspan.operators.running import running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 20_000
_KEYS = 2.0**32


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Words to take from each source, from a table (source, size).

    Sources in code point order, null last, get the weights in turn. Targets
    share ``share`` times all sizes by weight; none exceeds ``max_epochs`` times
    its source, and the excess goes to the others by weight. That is one level
    L with the sum of least(cap, L * weight) equal to the shared amount. In
    order of cap / weight, L is the largest of the levels that the sources not
    yet filled would get, so prefix sums over the sources find it.

    Returns source, place, source_size, target; one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per_source.withColumn("place", F.row_number().over(in_turn)).withColumn(
        "weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(share)
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return ranked.withColumn("level", level).select(
        "source", "place", "source_size",
        F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE, by_text: bool = False,
) -> DataFrame:
    """How many words of each document the mix takes.

    Keys are md5 of seed and id: uniform, and equal between runs. They are cut
    into even ranges, sorted inside a range, and sizes are summed over the
    ranges of a source and then inside each. A source's budget is the floor of
    its target: whole epochs first, then documents in key order; the document
    in which the budget ends gives the rest of the words only. So the words
    taken from a source are its budget exactly.

    Null and empty texts have size 0 and give nothing. A null source is a
    source of its own. Rows that repeat an id are ordered by size; rows equal in
    both stand next to each other in either order. With ``by_text`` a column text_digest
    (md5 of the text, null as empty) follows and orders rows after the size. No rows, no output. Ranges
    hold about ``rows_per_range`` rows, whatever share a source has.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    digest = [F.md5(text_of(text_column).cast("binary")).alias("text_digest")] if by_text else []
    rows = stored(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        word_count(text_column).alias("size"), key.alias("key"), *digest,
    ))
    ranges = max(1, -(-rows.count() // rows_per_range))
    start = F.conv(F.substring("key", 1, 8), 16, 10).cast("double")
    placed = _with_targets(rows, source_targets(rows, weights, share, max_epochs))
    placed = placed.withColumn("range", F.floor(start * F.lit(ranges / _KEYS)))
    summed = running_total(placed, "range", ["key", "doc_id", "size", *(["text_digest"] if by_text else [])], {"before": "size"}, by=("place",))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("before")
    return summed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
        "source", *(["text_digest"] if by_text else []),
    )


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join on the source, null included."""
    named = targets.withColumnRenamed("source", "target_source")
    return rows.join(named, rows["source"].eqNullSafe(named["target_source"])).drop("target_source")
