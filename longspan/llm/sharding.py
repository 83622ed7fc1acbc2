"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of
from longspan.operators.running import running_total

VIRTUAL_NODES = 128
ROWS_PER_BUCKET = 20_000


def _position(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) in clockwise order; a shard's nodes don't depend on the number of shards."""
    nodes = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            nodes.setdefault(_position(f"shard {shard} node {v}"), shard)
    return sorted(nodes.items())


def quotas(rows: int, shards: int) -> list[int]:
    """Bounds that differ by one at most and add up to all rows."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def place_counts(nodes: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, shard, first rank, end rank): where the keys of each arc go.

    ``counts`` has the number of keys on the arc that ends at each node. All
    keys first ask their own node's shard, in clockwise order; those that find
    it full continue clockwise to the next shard with room. Only counts are
    handled here, one per node, so this is small whatever the number of keys.
    """
    left = list(room)
    rest: list[tuple[int, int, int]] = []
    ranges = []
    for arc in sorted(counts):
        shard, n = nodes[arc][1], counts[arc]
        took = min(n, left[shard])
        left[shard] -= took
        if took:
            ranges.append((arc, shard, 0, took))
        if n > took:
            rest.append((arc, took, n))
    free = [i for i, (_, shard) in enumerate(nodes) if left[shard]]
    for arc, start, end in rest:
        while start < end:
            at = bisect.bisect_left(free, arc) % len(free)
            shard = nodes[free[at]][1]
            took = min(end - start, left[shard])
            ranges.append((arc, shard, start, start + took))
            start += took
            left[shard] -= took
            if not left[shard]:
                free = [i for i in free if nodes[i][1] != shard]
    return ranges


def assign(
    docs: DataFrame, shards: int, key: Column, columns: list[Column], order: list[str],
    virtual_nodes: int = VIRTUAL_NODES, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``columns`` of every row, with its shard and its slot there.

    ``key`` is the text that decides the place on the ring. Each row belongs to
    the arc that ends at the next node clockwise. Rows per arc are counted (one
    number per node comes to the driver), the counts are placed under the bounds
    of ``quotas``, and each row finds its range by its rank in the arc. Ranks
    are prefix sums over buckets of about ``rows_per_bucket`` rows, so an arc
    that holds a third of all rows is many tasks.

    Shards' row counts differ by one at most. Slots run from 0 in every shard
    without gaps. ``order`` names columns that order rows in a bucket; rows equal
    in all of them may swap slots. An empty table gives no rows.
    """
    nodes = ring(shards, virtual_nodes)
    cuts = [-float("inf"), *[float(p) + 1 for p, _ in nodes], float("inf")]
    position = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double")
    arcs = Bucketizer(splits=cuts, inputCol="position__", outputCol="arc__")
    rows = stored(
        arcs.transform(docs.select(*columns, position.alias("position__")))
        .withColumn("arc__", (F.col("arc__") % len(nodes)).cast("int")).drop("position__")
    )
    counts = {r["arc__"]: r["count"] for r in rows.groupBy("arc__").count().collect()}  # one per node
    ranges = place_counts(nodes, counts, quotas(sum(counts.values()), shards))
    filled = [0] * shards
    table = []
    for arc, shard, start, end in ranges:
        table.append((arc, shard, start, end, filled[shard] - start))
        filled[shard] += end - start
    spark = docs.sparkSession
    places = spark.createDataFrame(table, "arc__ int, shard int, start__ long, end__ long, shift__ long")
    split = spark.createDataFrame(
        [(arc, -(-n // rows_per_bucket)) for arc, n in counts.items()], "arc__ int, buckets__ long")
    bucketed = rows.join(F.broadcast(split), "arc__").withColumn(
        "bucket__", F.pmod(F.xxhash64(*order), F.col("buckets__"))).withColumn("one__", F.lit(1))
    ranked = running_total(bucketed, "bucket__", order, {"rank__": "one__"}, by=("arc__",))
    # At most two ranges per node and one more per shard.
    found = ranked.join(F.broadcast(places), "arc__").where(
        (F.col("rank__") >= F.col("start__")) & (F.col("rank__") < F.col("end__")))
    return found.withColumn("slot", F.col("rank__") + F.col("shift__")).drop(
        *[c for c in found.columns if c.endswith("__")])


def shard_documents(
    docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    The text decides the place on the ring, so equal texts stand together and
    spread over neighbouring shards only as far as the bounds force them. Null
    text counts as empty; a null id is allowed.
    """
    text = text_of(text_column).cast("binary")
    return assign(
        docs, shards, text_of(text_column),
        [F.col(id_column).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
         F.crc32(text).alias("text_crc32")],
        ["doc_id", "text_crc32", "size"], **options)
