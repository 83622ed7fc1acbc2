"""Conversation prefixes against a plain trie."""

import hashlib
import random
import zlib

import pytest

from longspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 string"


def plain(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c % 100 if c >= 0 else -(-c % 100)  # as SQL says it
        paths[c] = own.get(c - rest, [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def under(node):
        leaves, saved, todo = 0, 0, [node]
        while todo:
            n = todo.pop()
            leaves += n not in children
            saved += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
            todo += children.get(n, [])
        return leaves, saved

    out = []
    for node, held in members.items():
        ends = sorted(c for c in held if len(paths[c]) == len(node))
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children.get(node, [])),
            *under(node), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(df, **options)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def turns(conv, texts, role="user"):
    return [(conv, i, role, t, "extra", None) for i, t in enumerate(texts)]


def test_random_conversations_with_shared_starts(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, -3, 7_000_000_000]:
        length = draw.choice([1, 2, 3, 5, 9, 17, 20])
        start = ["s"] * draw.choice([0, 3, 8, 12])
        rows += turns(c, (start + [draw.choice("abé") for _ in range(length)])[:25])
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, block=2) == plain(rows)


def test_nulls_ties_copies_and_turnless(spark):
    rows = [
        (0, None, None, "first", "e", None), (0, 1, "user", None, "e", None), (0, 2, None, None, "e", None),
        *turns(1, ["x", "y"]), *turns(2, ["x", "y"]), *turns(300, []), *turns(301, ["only"]), *turns(302, ["a", "b"]),
        (None, 0, "user", "nobody", "e", None),
        *[(400, 0, "user", "same", "e", None)] * 4, *turns(401, ["x" * 20_000, ""]),
    ]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_long_conversations_go_through_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = turns(0, [str(i % 7) for i in range(100)]) + turns(1, [str(i % 7) for i in range(60)] + ["z"] * 30)
    rows += turns(100, [str(i % 7) for i in range(90)]) + turns(107, ["q"] * 50)
    assert found(spark, rows) == plain(rows)


def test_ends_of_one_node_in_several_pieces(spark, monkeypatch):
    ends = spark.range(0, 25_000, 1, 6).selectExpr("0L as depth", "0L as x1", "0L as x2", "id as conv_id")
    got = prefix_trie.end_digests(ends).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, range(25_000))).encode()).hexdigest()]
    batches = [__import__("pyarrow").RecordBatch.from_pydict({"depth": [0] * 5, "x1": [1] * 5, "x2": [2] * 5, "conv_id": [1, 2, 3, 4, 5]})] * 2
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    assert [t for b in prefix_trie._pieces(iter(batches)) for t in b.column("text").to_pylist()] == ["1,2,3", "4,5,1", "2,3,4", "5"]


@pytest.mark.parametrize("hot", [False, True])
def test_lookup_of_hot_keys(spark, hot):
    from pyspark.sql import functions as F

    from longspan.llm.common import lookup
    rows = spark.range(100).selectExpr("id", "id % 3 as k")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = lookup(rows, table, ["k"], (F.col("k") == 0) if hot else F.lit(False))
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(i, "ab"[i % 3]) for i in range(100) if i % 3 < 2]
