"""Repeats and near copies beside brute force."""

import hashlib
import random
from collections import Counter

import pytest

from longspan.llm import near_join, repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    rows = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        rows.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return rows


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(90), text(15)
    texts = [None, "", "x" * 199, "x" * 200, "y" * 700, "ab" * 300, passage, passage[:199]]
    for _ in range(40):
        cut = r.randint(0, 60)
        texts.append(text(r.randint(5, 120)) + (passage[cut:cut + r.randint(150, 400)] if r.random() < 0.6 else line) + text(30))
    return texts + texts[10:14] + [texts[12][:-3] + "zzz"]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats_equal_brute_force(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs, hot_pieces=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_near_copies_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [r.choice(words) for _ in range(120)]
    texts = [None, "", " \n ", "a b", "a  b", "a b c"]
    for _ in range(60):
        edited = list(base)
        for _ in range(r.randint(0, 4)):
            edited[r.randrange(len(edited))] = r.choice(words)
        texts.append(" ".join(edited))
    texts += [" ".join(r.choice(words) for _ in range(50)) for _ in range(30)]
    texts += texts[6:9] + [texts[6].replace(" ", "\t")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, digest int")
    got = {row["doc_id"]: row for row in near_join.near_duplicates(docs, block=16).collect()}
    assert len(got) == len(texts)

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    normal = [" ".join((t or "").split()) for t in texts]
    distinct = {t: min(i for i, x in enumerate(normal) if x == t) for t in normal}
    sets = {t: grams(t) for t in distinct}
    linked = {t: [u for u in distinct if u != t and sets[t] | sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in distinct}
    for i, t in enumerate(normal):
        assert got[i]["n_links"] == len(linked[t])
        assert got[i]["text_id"] == distinct[t]
        group, todo = {t}, [t]
        while todo:
            for u in linked[todo.pop()]:
                if u not in group:
                    group.add(u)
                    todo.append(u)
        assert got[i]["class_id"] == min(distinct[u] for u in group)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0
    assert near_join.near_duplicates(docs).count() == 0
