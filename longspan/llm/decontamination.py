"""Benchmark passages in documents, found by spaced seeds.

A mask names the words of a window that are hashed; the others may differ. Seeds
of the benchmark and of the documents meet in a join on the hash, and each hit
is verified word by word around it. Everything is built of SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of

# Fixed masks over eight words: 1 is hashed, 0 may be substituted. Any two changes among 13 words leave a seed.
MASKS = ("11011011", "11100111", "10111101", "10101111")
SPAN = 8
WINDOW = 13
LEAST_EQUAL = 11
LEAD = WINDOW - SPAN
# Hashes that may be broadcast: 16 bytes each, so 16 MB at most.
BROADCAST_SEEDS = 1_000_000


def words(column: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_of(column)), r"[^\p{L}\p{N}]+"), "")


def digest(column: str) -> Column:
    """Tells texts apart where ids do not."""
    return F.md5(text_of(column).cast("binary"))


def _seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per position and mask: hash, at, the kept columns and words."""
    long_enough = rows.where(F.size("words") >= SPAN)
    placed = long_enough.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - SPAN)).alias("at"))
    hashes = [
        F.xxhash64(F.lit(m), *[F.col("words")[F.col("at") + i] for i, bit in enumerate(mask) if bit == "1"])
        for m, mask in enumerate(MASKS)
    ]
    return placed.select(*keep, "words", "at", F.explode(F.array(*hashes)).alias("hash"))


def _equal_words() -> Column:
    """Most equal words of the item's windows that hold the hit's seed, aligned by it; words off either text differ.

    A shorter item is one window, and its missing words count as equal.
    """
    same = F.transform(
        F.sequence(F.col("item_at") - LEAD, F.col("item_at") + WINDOW - 1),
        lambda i: F.get("item", i) == F.get("near", i - F.col("item_at") + F.col("offset")))
    # A transform of one value, so that the words are compared once for all windows.
    most = F.transform(F.array(same), lambda flags: F.greatest(*[
        F.size(F.filter(F.slice(flags, 1 + start, WINDOW), lambda equal: equal)) for start in range(LEAD + 1)]))[0]
    return most + F.greatest(F.lit(0), WINDOW - F.size("item"))


def _changes() -> Column:
    """Words of a window that may differ: 2 of 13, 1 of a shorter item, none of one seed's length."""
    size = F.size("item")
    return F.when(size >= WINDOW, WINDOW - LEAST_EQUAL).when(size > SPAN, 1).otherwise(0)


def _short_hits(items: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Items of fewer words than a seed spans, whole: all their words meet the document's words of that number.

    Equal hashes are only candidates; the words are compared. None without such items.
    """
    short = stored(items.where(F.size("words").between(1, SPAN - 1)).select(
        "item_id", F.col("words").alias("item"), F.size("words").alias("size"), F.xxhash64("words").alias("hash")).distinct())
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # 7 numbers at most
    if not sizes:
        return None
    hashes = short.select("hash").distinct()
    if hashes.count() <= BROADCAST_SEEDS:
        hashes = F.broadcast(hashes)

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - (size - 1))
        return F.when(F.size("words") >= size, F.transform(starts, lambda at: F.slice("words", at, F.lit(size)))).otherwise(
            F.array().cast("array<array<string>>"))

    placed = rows.select(*keys, F.explode(F.concat(*[runs(size) for size in sorted(sizes)])).alias("near")).withColumn("hash", F.xxhash64("near"))
    met = placed.join(hashes, "hash", "left_semi").groupBy(*keys, "hash", "near").agg(F.count(F.lit(1)).alias("hits"))
    return met.join(short, "hash").where(F.col("near") == F.col("item")).select(*keys, "item_id", "hits")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", by_text: bool = False,
) -> DataFrame:
    """doc_id, item_id, hits and matched for each document that holds a passage of an item.

    Of 13 words of the item at most 2 may differ in the document, at the same places;
    of all words of an item of 9 to 12 one, of an item of 8 none. All windows that
    hold a hit's seed are compared, and every such passage has a seed. ``hits`` counts
    the verified seeds, ``matched`` is the most equal words of a window, where what an
    item lacks of 13 words counts as equal. Words are lower-case runs of letters and
    digits. Items of 1 to 7 words have no seed: they match where all their words stand
    whole and in order. Items without a word match nothing; nor do null or empty texts. Rows that share an id are judged together, with ``by_text`` only those
    of equal texts: the column text_digest (``digest`` of the text) then follows doc_id.
    Empty tables give no rows.

    The benchmark's distinct hashes are broadcast only up to ``BROADCAST_SEEDS``;
    beyond that the join shuffles. Each hit carries only the words near it, so a
    passage in a third of all documents makes work in proportion.
    """
    items = benchmark.select(F.col(item_column).alias("item_id"), words(item_text_column).alias("words"))
    seeds = stored(_seeds(items, "item_id").select(
        "hash", "item_id", F.col("at").alias("item_at"), F.col("words").alias("item")).distinct())
    hashes = seeds.select("hash").distinct()
    if hashes.count() <= BROADCAST_SEEDS:
        hashes = F.broadcast(hashes)
    keys = {"doc_id": F.col(id_column)} | ({"text_digest": digest(text_column)} if by_text else {})
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], words(text_column).alias("words"))
    first = F.greatest(F.col("at") - WINDOW, F.lit(0))
    hits = _seeds(rows, *keys).join(hashes, "hash", "left_semi").select(
        "hash", *keys, "at", (F.col("at") - first).alias("offset"),
        F.slice("words", first + 1, F.lit(2 * WINDOW + SPAN)).alias("near"))
    verified = hits.join(seeds, "hash").withColumn("matched", _equal_words())
    found = verified.where(F.col("matched") >= WINDOW - _changes()).select(*keys, "item_id", F.lit(1).alias("hits"), "matched")
    whole = _short_hits(items, rows, list(keys))
    if whole is not None:
        found = found.unionByName(whole.withColumn("matched", F.lit(WINDOW)))
    return found.groupBy(*keys, "item_id").agg(F.sum("hits").cast("long").alias("hits"), F.max("matched").alias("matched"))
