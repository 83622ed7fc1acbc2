"""The trie of conversation prefixes, by digests of blocks of turns.

Conversations meet first in blocks of several turns: the digest of a whole prefix
at a block's end groups all that agree so far. Only where the blocks that follow
one prefix differ are their turns compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import HOT, lookup, stored, text_of
from longspan.operators.running import ranked

BLOCK = 8
# Windows over the turns of one conversation hold at most this many rows; a multiple of BLOCK.
CHUNK = 4_096
PIECE_IDS = 50_000
GROUP, MOST_SHARED = 100, 6
NODE = ["depth", "x1", "x2"]


def running(rows: DataFrame, key: str, place: str, deep: bool, totals: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """Inclusive running aggregates of each key by place, in chunks of places.

    ``totals`` maps a target to (aggregate, source, combine). With ``deep`` false no
    place lies beyond the first chunk and none needs what comes from other chunks.
    """
    def towards(column: str) -> Column:
        return F.col(column).desc() if backwards else F.col(column).asc()

    chunked = rows.withColumn("chunk", F.floor((F.greatest(F.col(place), F.lit(1)) - 1) / CHUNK))
    inside = Window.partitionBy(key, "chunk").orderBy(towards(place)).rowsBetween(Window.unboundedPreceding, 0)
    found = chunked.withColumns({t: f(s).over(inside) for t, (f, s, _) in totals.items()})
    if not deep:
        return found
    sums = chunked.groupBy(key, "chunk").agg(*[f(s).alias(f"__{t}") for t, (f, s, _) in totals.items()])
    before = Window.partitionBy(key).orderBy(towards("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "chunk", *[
        F.coalesce(f(f"__{t}").over(before), F.lit(0)).alias(f"__{t}") for t, (f, _, _) in totals.items()])
    return found.join(offsets, [key, "chunk"]).withColumns(
        {t: c(F.col(t), F.col(f"__{t}")) for t, (_, _, c) in totals.items()}).drop(*[f"__{t}" for t in totals])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _add(a: Column, b: Column) -> Column:
    return a + b


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Turns of the rebuilt conversations, one row per conversation, and the number of turns read.

    Turns: conv_id, depth (from 1), t1 and t2 (128 bits of role and text), length in
    code points. Conversation c starts with the first h turns of the one whose
    id is c - c % 100 (all if it has fewer, none if it is absent), h being
    crc32(c) % 6, and goes on with its own turns after its first h.
    """
    turns = stored(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"),
        F.xxhash64(text_of("role"), text_of("text")).alias("t1"),
        F.xxhash64(F.md5(text_of("text")), text_of("role")).alias("t2"),
        F.length(text_of("text")).alias("length")))
    placed = stored(ranked(turns, [F.col("turn").asc_nulls_first(), "role", "t1", "t2"], ("conv_id",), "place").drop(
        "turn", "role"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    counted = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    first = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < MOST_SHARED)).groupBy(
        F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "t1", "t2", "length"))).alias("given"))
    convs = stored(counted.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left").select(
        "conv_id", "own", shared.alias("h"),
        F.slice(F.coalesce("given", F.array().cast(first.schema["given"].dataType)), 1, shared.cast("int")).alias("given")))
    total = turns.count()
    own = lookup(
        placed.where(F.col("place") > shared), convs.select("conv_id", "own", F.size("given").alias("start")),
        ["conv_id"], F.col("own") * HOT > F.lit(total))
    later = own.select("conv_id", (F.col("place") - shared + F.col("start")).alias("depth"), "t1", "t2", "length")
    given = convs.select("conv_id", F.explode("given").alias("g")).select(
        "conv_id", F.col("g.place").alias("depth"), "g.t1", "g.t2", "g.length")
    return later.unionByName(given), convs.select("conv_id"), total


def turn_blocks(turns: DataFrame, deep: bool, block: int = BLOCK) -> DataFrame:
    """Blocks of each conversation: conv_id, start and end (depth and digest of the prefix there), turns.

    A prefix's digest is the xor of hashes of (depth, turn), 128 bits in all, so
    digests of chunks combine like sums.
    """
    hashed = turns.withColumns({"u1": F.xxhash64("depth", "t1", "t2"), "u2": F.xxhash64("t2", "depth", "t1")})
    digests = running(
        hashed, "conv_id", "depth", deep, {"x1": (F.bit_xor, "u1", _xor), "x2": (F.bit_xor, "u2", _xor)})
    return digests.groupBy("conv_id", "chunk", F.floor((F.col("depth") - 1) / block).alias("k")).agg(
        F.min(F.struct((F.col("depth") - 1).alias("depth"), _xor(F.col("x1"), F.col("u1")).alias("x1"),
                       _xor(F.col("x2"), F.col("u2")).alias("x2"))).alias("start"),
        F.max(F.struct(*NODE)).alias("end"),
        F.array_sort(F.collect_list(F.struct(*NODE, "length"))).alias("turns"),
    ).drop("chunk", "k")


def _nodes_of(blocks: DataFrame, *carried: str) -> DataFrame:
    """One row per turn of each block, with the digest of the prefix before it."""
    opened = blocks.select("start", "turns", F.posexplode("turns").alias("i", "t"), *carried)
    above = F.when(F.col("i") == 0, F.struct(F.col("start.x1"), F.col("start.x2"))).otherwise(
        F.struct(F.expr("turns[i - 1].x1").alias("x1"), F.expr("turns[i - 1].x2").alias("x2")))
    return opened.select("t.depth", "t.x1", "t.x2", "t.length", above.alias("above"), *carried)


def prefix_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes below the root: depth, digest, length of the last text, digest above, n_convs, conv_id (least member)."""
    grouped = stored(blocks.groupBy("end").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("start").alias("start"),
        F.first("turns").alias("turns")))
    alone = grouped.groupBy("start").agg(F.count(F.lit(1)).alias("siblings"), F.first("end").alias("end")).where(
        "siblings = 1").select("end")
    agreed = _nodes_of(grouped.join(alone, "end", "left_semi"), "n", "least").withColumnsRenamed(
        {"n": "n_convs", "least": "conv_id"})
    # Siblings differ: the same turns may stand in several of their blocks.
    refined = _nodes_of(grouped.join(alone, "end", "left_anti"), "n", "least").groupBy(*NODE).agg(
        F.first("length").alias("length"), F.first("above").alias("above"), F.sum("n").alias("n_convs"),
        F.min("least").alias("conv_id"))
    return agreed.unionByName(refined)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node as text, at most PIECE_IDS ids in each."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_pylist([dict(zip(NODE, node), first=ids[0], text=",".join(map(str, ids)))], PIECES)

    for batch in batches:
        out = []
        for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if node is not None and (key != node or len(ids) >= PIECE_IDS):
                out.append(piece())
                ids = []
            node = key
            ids.append(conv_id)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield piece()


PIECES = pa.schema([*[(c, pa.int64()) for c in NODE], ("first", pa.int64()), ("text", pa.string())])
HASHES = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; only the digest's state is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "text"))):
            if key != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), HASHES)], schema=HASHES)
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(HASHES.names, (*node, state.hexdigest())))], HASHES)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas.

    Ids of one node may be a third of all: they are sorted over several partitions and
    written as pieces of text there; one task then only hashes pieces in order.
    """
    fields = "depth long, x1 long, x2 long"
    count = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(count, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        _pieces, f"{fields}, first long, text string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, f"{fields}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id, the least member; depth; parent_conv_id; n_convs; n_children; n_leaves and
    saved_tokens over the subtree; ends_sha256. Turns of one conversation come by turn,
    null first; those of one turn number by role and then by a hash of the text, and
    repeated rows are turns of their own. Null role and text are empty. Rows of a
    null conv_id belong to no conversation. Without conversations there is no row;
    a conversation without turns ends at the root. Further columns are ignored.

    The least member of a node owns it, and what a conversation owns is one chain of
    nodes down to its end. A node's subtree holds the rest of its owner's chain, and
    the whole chains of its other members, so sums over subtrees are sums over members:
    no walk through levels. Blocks shared whole are summed as blocks, those in which a
    chain begins turn by turn.
    """
    turns, convs, total = rebuilt_turns(conversations)
    turns = stored(turns)
    deep = not turns.where(F.col("depth") > CHUNK).isEmpty()
    blocks = stored(turn_blocks(turns, deep, block))
    zero = F.lit(0).cast("long")
    ends = stored(convs.join(blocks.groupBy("conv_id").agg(F.max("end").alias("end")), "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in NODE]))
    nodes = stored(prefix_nodes(blocks).unionByName(
        ends.groupBy().agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
            *[zero.alias(c) for c in NODE], F.lit(0).alias("length"),
            F.lit(None).cast("struct<x1:bigint,x2:bigint>").alias("above"), "n_convs", "conv_id")))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("above.x1").alias("x1"), F.col("above.x2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = stored(nodes.join(children, NODE, "left").join(end_digests(ends), NODE, "left").select(
        *nodes.columns, F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ((F.col("n_convs") - 1) * F.col("length")).alias("saved"),
        F.col("n_children").isNull().cast("long").alias("leaf")))
    chains = stored(full.groupBy("conv_id").agg(
        F.min(F.struct("depth", "above")).alias("head"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).select(
        "conv_id", F.col("head.depth").alias("head"), "head.above", "saved", "leaf"))
    n_chains = chains.count()

    heads = chains.where("head > 0").select(
        F.col("conv_id").alias("child"), (F.col("head") - 1).alias("depth"), "above.x1", "above.x2")
    parents = lookup(
        heads, full.select(*NODE, F.col("conv_id").alias("parent_conv_id"), "n_children"), NODE,
        F.col("n_children") * HOT > F.lit(n_chains))
    parents = parents.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")

    # Rebuilt turns are at most 6 times those read, so these are at most 3 * HOT.
    long_ones = [r["conv_id"] for r in ends.where(F.col("depth") * HOT > F.lit(2 * total)).select("conv_id").collect()]
    begun = lookup(
        blocks, chains.drop("above"), ["conv_id"], F.col("conv_id").isin(long_ones) if long_ones else F.lit(False)).where(
        F.col("start.depth") + 1 < F.col("head"))
    whole = begun.where(F.col("end.depth") < F.col("head")).groupBy("end").agg(
        F.first("turns").alias("turns"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    partial = begun.where(F.col("end.depth") >= F.col("head")).select(
        F.filter("turns", lambda t: t["depth"] < F.col("head")).alias("turns"), "saved", "leaf")
    below = whole.drop("end").unionByName(partial).select(F.explode("turns").alias("t"), "saved", "leaf").select(
        "t.depth", "t.x1", "t.x2", "saved", "leaf").unionByName(
        chains.where("head > 0").select(*[zero.alias(c) for c in NODE], "saved", "leaf"))
    others = below.groupBy(*NODE).agg(F.sum("saved").alias("other_saved"), F.sum("leaf").alias("other_leaves"))

    rest = running(full, "conv_id", "depth", deep, {
        "own_saved": (F.sum, "saved", _add), "own_leaves": (F.sum, "leaf", _add)}, backwards=True)
    return rest.join(parents, ["conv_id", "depth"], "left").join(others, NODE, "left").select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children",
        (F.col("own_leaves") + F.coalesce("other_leaves", zero)).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("other_saved", zero)).alias("saved_tokens"),
        "ends_sha256")
