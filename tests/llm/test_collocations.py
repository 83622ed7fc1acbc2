"""Phrases against plain counting."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa

from longspan.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, count long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, covered=80, top=2_000):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in chosen.items()):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n[lang], score))
        for rank, (_, _, phrase, *rest) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), *rest))
    return sorted(out)


def found(spark, rows, **options):
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed=3, docs=500):
    draw = random.Random(seed)
    words = ["The", "of", "été", "a", "New", "York", "x&y", " ", "Ž", "zz"]
    out = []
    for i in range(docs):
        text = "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(draw.randrange(0, 120)))
        out.append((i, text, draw.choice(["en", "en", "en", "fr", None]), "clash", 1))
    return out + [(None, None, "en", None, None), (1, "", None, None, None), (2, "new york " * 300, "en", None, None)]


def test_counts_scores_and_order(spark):
    rows = corpus()
    expected = plain(rows)
    assert len(expected) > 30
    assert found(spark, rows) == expected
    assert found(spark, rows, top=5) == plain(rows, top=5)


def test_small_shards_ranges_and_slices_change_nothing(spark):
    rows = corpus(4, 60) + [(9, "one piece without end " * 400, "en", None, None), (10, "w" * 5_000, "fr", None, None)]
    assert found(spark, rows, range_windows=50, shard_bytes=700) == plain(rows)


def test_splitters_cut_one_frequent_prefix(spark):
    rows = [(i, " ".join(f"the same w{(i * 37 + j) % 500}" for j in range(50)), "en", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = collocations.splitters(df.select("lang", "text"), range_windows=300)
    assert sum(words[0] == b"the" for _, words in cuts) > 1
    assert found(spark, rows, range_windows=300) == plain(rows)


def test_products_beyond_64_bits(spark):
    frequent, many = 2_000_000_000, 5_000
    words = pa.array([b"a", b"b"], pa.binary())
    import numpy as np
    columns, weights = np.array([[1, 2], [2, 0], [0, 0], [0, 0]], np.int32), np.array([frequent, frequent])
    row = {"range": 0, "lang": "en", **collocations.trie(columns, weights, words)}
    table = collocations._union(pa.Table.from_pylist([row] * many, collocations.BLOCKS), 30)
    frequent *= many
    counts = {(r["size"], r["phrase"]): r["count"] for r in table.to_pylist()}
    assert counts[2, "a b"] == frequent and counts[0, ""] == 2 * frequent
    score = spark.sql(
        f"select (cast(2000000 as decimal(38,0)) * cast({frequent}L as decimal(20,0))) div cast({frequent}L + {frequent}L as decimal(20,0)) s")
    assert score.first()["s"] == 1_000_000


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, None, None)]) == []


def test_memory_of_a_shard():
    draw = random.Random(5)
    names = [f"w{i:04}" for i in range(3_000)]
    words = [draw.choice(names).encode() for _ in range(300_000)]
    text = b" ".join(words)
    list(collocations._shard([(b"a b", 0, False)], ["en"], []))  # imports
    tracemalloc.start()
    sizes = [batch.nbytes for batch in collocations._shard([(text, 0, False)], ["en"], [])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(text)
    assert len(sizes) > 2 and max(sizes) < 4_000_000
    tries = pa.Table.from_batches(collocations._shard([(text, 0, False)], ["en"], []))
    counts = {r["phrase"].encode(): r["count"] for r in collocations._union(tries, 30).to_pylist() if r["size"] < 2}
    assert counts.pop(b"") == len(words)
    assert {w: n for w, n in counts.items() if n >= 30} == {w: n for w, n in Counter(words).items() if n >= 30}
