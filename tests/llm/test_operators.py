"""Small cases and brute force for the text operators."""

import base64
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from longspan.llm import (
    decontamination, exact_dedup, language, mixing, sharding, token_counts, toxicity, warc,
)
from tools.check import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
ODD = [None, "", " \n", "a b", "ab", "ab", "é" * 5, "word " * 3000, "x" * 50_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, None if i % 3 else "en", None if i % 2 else "s", None, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[4:5], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op10_exact_dedup", "op5_mix_sources", "op6_warc_chunks"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_exact_groups(odd, none):
    for limits in ({}, {"hot_share": 1, "least_hot": 1}):
        rows = exact_dedup.exact_groups(odd, **limits).collect()
        assert len(rows) == len(ODD) + 1
        assert sum(r["kept"] for r in rows) == len({re.sub(r"\s", "", t or "") for t in ODD})
        assert {r["group_size"] for r in rows if r["keep_id"] == 3} == {4}
    assert exact_dedup.exact_groups(none).count() == 0


def test_mix_meets_budgets(odd, none):
    rows = mixing.mix(odd, rows_per_range=2).collect()
    assert len(rows) == len(ODD) + 1
    for source in (None, "s"):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(none).count() == 0


def test_shards(spark, odd, none):
    def check(rows, shards):
        counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
        for s in range(shards):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))

    check(sharding.shard_documents(odd, 3).collect(), 3)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    before = sharding.shard_documents(docs, 10, rows_per_bucket=50).collect()
    check(before, 10)
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 11).collect()}
    assert sum(after[r["doc_id"]] != r["shard"] for r in before) < 500
    assert sharding.shard_documents(none, 4).count() == 0


def test_archives_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", "", "a\r\n\r\nb", "é" * 5000, "é" * 5000] + ["".join(r.choices("abc\n", k=3000)) for _ in range(4)]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\n", t, 1) for i, t in enumerate(texts)] + [(4, "u", texts[4], 1)],
                                  "page_id long, url string, html string, chunk int")
    manifest = warc.write_archives(warc.chunk_table(pages, chunk_bytes=700), warc.archive_folder(spark), archive_bytes=1000)
    rows = warc.read_archives(manifest, chunk_bytes=512).collect()
    assert manifest.count() > 1
    found = {}
    for row in sorted(rows, key=lambda x: x["chunk"]):
        found.setdefault(row["record_id"], []).append(row)
    assert len(found) == len(texts) + 1
    for parts in found.values():
        text = (texts[parts[-1]["page_id"]] or "").encode()
        assert parts[-1]["payload_bytes"] == len(text)
        assert parts[-1]["payload_digest"] == base64.b32encode(hashlib.sha1(text).digest()).decode()
        assert max(len(p["payload"]) for p in parts) <= 512
        if parts[0]["record_type"] == "response":
            assert b"".join(bytes(p["payload"]) for p in parts) == text
    types = sorted((p[0]["page_id"], p[0]["record_type"], p[0]["refers_to"]) for p in found.values() if p[0]["page_id"] in (0, 1, 2, 4, 5))
    assert [t[1] for t in types].count("response") == 2
    assert {t[2] for t in types if t[1] == "revisit"} == {0, 4}


def test_token_table(spark, odd, none):
    lengths = sorted(r[0] for r in token_counts.encoded_lengths(odd).collect())
    table_ = token_counts.length_table(token_counts.encoded_lengths(odd), per_bucket=8)
    limits = [0, 1, 2, 3, 100, 10**6]
    got = {r["limit"]: r["tokens"] for r in token_counts.truncated_totals(table_, limits).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in limits}
    for r in table_.collect():
        assert r["docs_at_least"] == sum(n >= r["n_tokens"] for n in lengths)
        assert r["tokens_truncated"] == got.get(r["n_tokens"], sum(min(n, r["n_tokens"]) for n in lengths))
    half = token_counts.quantiles(table_, [0.5]).first()["n_tokens"]
    assert half == lengths[(len(lengths) - 1) // 2]
    assert token_counts.length_table(token_counts.encoded_lengths(none)).count() == 0


@pytest.mark.parametrize("n", [10, 7])
def test_token_quantiles_at_exact_shares(spark, n):
    lengths = list(range(1, n + 1))
    made = token_counts.length_table(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    shares = [0.0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 0.9, 0.95, 1.0]
    found = {r["probability"]: r["n_tokens"] for r in token_counts.quantiles(made, shares).collect()}
    tenths = {p: round(p * 100) for p in shares}
    assert found == {p: lengths[max(0, -(-h * n // 100) - 1)] for p, h in tenths.items()}
    assert token_counts.quantiles(made.limit(0), [0.5]).first()["n_tokens"] is None


def test_language(spark, odd, none):
    words = {"aa": ["the", "and", "with", "house"], "bb": ["der", "und", "mit", "schloß"], "cc": ["дом", "река", "это"]}
    r = random.Random(2)
    docs = spark.createDataFrame(
        [(i, " ".join(r.choices(words[k], k=20)), k) for i, k in enumerate(list(words) * 40)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    found = language.identify(docs, model).join(docs, "doc_id").collect()
    assert all(x["lang"] == x["lang_pred"] for x in found)
    mixed = spark.createDataFrame([(1, "the and with house. " * 5 + "und mit der schloß " * 5)], "doc_id long, text string")
    spans = language.identify(mixed, model, spans=True).first()["spans"]
    assert [(s["lang"], s["start"]) for s in spans] == [("aa", 0), ("bb", 100)]
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD) + 1 and sum(x["lang_pred"] == "und" for x in rows) == 3
    assert language.identify(none, language.fit(none)).count() == 0
    assert {x["lang_pred"] for x in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_paths_equal_brute_force():
    import itertools

    import numpy as np
    rng = np.random.default_rng(0)
    scores, text = rng.normal(size=(11, 3)) * 3, np.array([0] * 6 + [1] + [2] * 4)
    path = language.best_paths(scores, text, 2.0)
    for t in range(3):
        own = scores[text == t]
        value = lambda p, own=own: sum(own[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=len(own)))
        assert abs(value(path[text == t].tolist()) - best) < 1e-5


def test_many_languages(spark):
    import numpy as np
    for k in (150, 300):
        wanted = np.repeat([0, k - 1, 126, 140, 130], 4)
        scores = np.zeros((len(wanted), k))
        scores[np.arange(len(wanted)), wanted] = 10.0
        assert language.best_paths(scores, np.zeros(len(wanted), int)).tolist() == wanted.tolist()
        assert language.best_paths(scores, np.arange(len(wanted))).tolist() == wanted.tolist()
    r = random.Random(11)
    names = [f"l{i:03}" for i in range(150)]
    words = {n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(8)] for n in names}
    docs = spark.createDataFrame(
        [(i, " ".join(r.choices(words[n], k=20)), n) for i, n in enumerate(names * 10)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == names
    rows = language.identify(docs, model, spans=True).join(docs, "doc_id").collect()
    assert all(x["lang"] == x["lang_pred"] == x["spans"][0]["lang"] for x in rows)


def test_toxicity(spark, odd, none):
    r = random.Random(4)
    plain = ["".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        text = r.choices(plain, k=40) + (r.choices(["vilebeast", "scumbagg", "wretchedd"], k=3) if toxic else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    found = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert sum((found[i] >= 0.3) == bool(t) for i, _, t in rows) > 590
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ODD) + 1 and all(0 <= x["score"] <= 1 for x in scores)
    assert toxicity.fit(none, docs.select("doc_id", "toxic")) is None
    assert toxicity.score(none, None).count() == 0


def test_training_draws_different_texts(spark, monkeypatch):
    from longspan.llm.common import drawn
    texts = [f"text {i} {'vile' if i % 3 else 'kind'} word{i % 7}" for i in range(2000)]
    rows = [(i, t, "aa", int(i % 3 > 0)) for i, t in enumerate(texts)] + [(2000 + i, f"text {i % 2} copy", "aa", i % 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    sizes = []
    measured = toxicity._features

    def counted(sample, distances):
        found = measured(sample, distances)
        sizes.append((len(found[0]), sample.select("text").distinct().count()))
        return found

    monkeypatch.setattr(toxicity, "_features", counted)
    for wanted in (10_000, 400):
        sizes.clear()
        assert toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), fit_rows=wanted) is not None
        assert all(n == different for n, different in sizes) and sizes[-1][0] <= 1.3 * wanted
    # Both copies' texts count once for the language too: its letters are those of different texts.
    once, often = (language.fit(d).scores for d in (docs.dropDuplicates(["text"]).withColumn("doc_id", F.lit(1)), docs.withColumn("doc_id", F.lit(1))))
    assert (once == often).all()
    # A rate far below one in a million still draws.
    some = spark.range(3_000_000).select(F.col("id").cast("string").alias("text"))
    assert 0 < drawn(some, "text", 3 * 10**11, 3 * 10**6).count() < 100


def test_benchmark_passages_equal_brute_force(spark, odd, none):
    r = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [[r.choice(words) for _ in range(n)] for n in (4, 9, 13, 30, 60)]
    docs, wanted = [], set()
    for i in range(60):
        doc = [r.choice(words) for _ in range(r.randint(0, 50))]
        if i % 3:
            k = r.randrange(1, len(items))
            item = list(items[k])
            changes = i % 4
            for at in r.sample(range(len(item)), changes):
                item[at] = "changed"
            doc[len(doc) // 2:len(doc) // 2] = item
            if changes == 0:
                wanted.add((i, k))
        docs.append((i, " ".join(doc).title() + ".", 1))
    bench = spark.createDataFrame([(k, ", ".join(x)) for k, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, hits int")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(df, bench).collect()}

    def holds(text, item):
        doc, size = re.findall(r"\w+", text.lower()), min(13, len(item))
        pad = [None] * 13 + doc + [None] * 13
        return any(
            sum(a == b for a, b in zip(item[s:s + size], pad[d:d + size])) + 13 - size >= 11
            for s in range(len(item) - size + 1) for d in range(len(pad) - size + 1))

    assert wanted <= found
    assert all(holds(docs[i][1], items[k]) for i, k in found)
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_every_passage_within_the_tolerance_is_found(spark):
    from itertools import combinations
    r = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    item = r.sample(words, 40)
    docs, wanted = [], set()
    for size, changes in ((13, 2), (14, 2), (16, 3)):
        for places in combinations(range(size), changes):
            start = r.randrange(len(item) - size + 1)
            passage = [f"x{i}" if i in places else w for i, w in enumerate(item[start:start + size])]
            if any(sum(i in places for i in range(s, s + 13)) <= 2 for s in range(size - 12)):
                wanted.add(len(docs))
            # Some passages stand at an end of the document.
            pad = [["y"] * r.choice((0, 3, 20)) for _ in range(2)]
            docs.append((len(docs), " ".join(pad[0] + passage + pad[1])))
    for cut in (1, 2):  # the document begins or ends inside the window
        for place in range(cut, 13) if cut == 1 else [None]:
            passage = ["x" if i == place else w for i, w in enumerate(item[9:22])]
            for text in (passage[cut:], passage[::-1][cut:][::-1]):
                if place is None or text.count("x"):
                    wanted.add(len(docs))
                    docs.append((len(docs), " ".join(text)))
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {x["doc_id"] for x in found} == wanted
    assert all(11 <= x["matched"] <= 13 for x in found)


def test_tolerance_of_short_items(spark):
    from itertools import combinations
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(8, 13)}
    docs, wanted = [], set()
    for n, item in items.items():
        for changes in (0, 1, 2):
            for places in combinations(range(n), changes):
                if changes <= (0 if n == 8 else 1):
                    wanted.add((len(docs), n))
                docs.append((len(docs), "a b " * (len(docs) % 2) + " ".join("y" if i in places else w for i, w in enumerate(item)) + " c" * (len(docs) % 3)))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == wanted


def test_short_items_are_found_whole(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(r.choices(vocabulary, k=k))) for k in range(1, 13)] + [(20, ""), (21, None), (22, "w1 w2"), (23, "w1 w2")]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30)))) for i in range(150)]
    docs += [(200 + k, f"a b {text} c") for k, text in items if text] + [(300, None), (301, ""), (302, "W1, w2")]
    rows = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]): (x["hits"], x["matched"]) for x in rows}
    assert len(found) == len(rows)

    def places(text, item, changes):
        a, b = (text or "").lower().replace(",", "").split(), (item or "").split()
        return sum(sum(x != y for x, y in zip(a[i:], b, strict=False)) <= changes for i in range(len(a) - len(b) + 1)) if b else 0

    for i, text in docs:
        for k, item in items:
            size = len((item or "").split())
            n = places(text, item, 1 if size > 8 else 0)
            if size < 8:
                assert found.get((i, k)) == ((n, 13) if n else None), (text, item)
            else:
                assert ((i, k) in found) >= (n > 0)
    assert not any(k in (20, 21) for _, k in found)


def test_warc_repeated_rows_and_large_payloads(spark):
    big = "x" * 5000
    rows = [(1, "u", big), (1, "u", big), (1, "u", big), (1, "v", big), (2, "u", big), (None, None, big), (None, None, ""), (None, None, None),
            (5, "u", "short"), (5, "u", "short"), (3, None, "another")]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string").repartition(5)
    for least in (0, 100):
        chunks = warc.chunk_table(pages, least_revisit_bytes=least, chunk_bytes=700)
        manifest = warc.write_archives(chunks, warc.archive_folder(spark))
        last = warc.read_archives(manifest, chunk_bytes=512).where("last").collect()
        assert len(last) == 2 * len(rows) and len({x["record_id"] for x in last}) == len(last)
        for payload in {html or "" for _, _, html in rows}:
            data = payload.encode()
            mine = [x for x in last if x["payload_bytes"] == len(data)]
            ids = [i for i, _, html in rows * 2 if (html or "") == payload]
            assert sorted(map(str, ids)) == sorted(str(x["page_id"]) for x in mine)
            own = [x for x in mine if x["record_type"] == "response"]
            assert len(own) == (len(mine) if len(data) < least else 1)
            if len(data) >= least:
                first = min((i for i in ids if i is not None), default=None)
                assert own[0]["page_id"] == first and all(x["refers_to"] == first for x in mine if x["record_type"] == "revisit")
    empty = pages.limit(0)
    assert warc.round_trip(empty).count() == 0


def test_only_chunks_move(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string").repartition(2)
    plan = warc.chunk_table(pages, chunk_bytes=700)._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.split("\n") if "RepartitionByExpression" in line or "Join" in line or "Aggregate" in line]
    assert moved
    for node in plan.split("RepartitionByExpression [row")[1:]:
        assert "Generate explode" in node  # cut below the exchange
    assert not any("payload" in line for line in moved)


def test_limits_and_percentiles_of_the_length_table(spark):
    r = random.Random(6)
    for n in (1, 7, 10, 250):
        lengths = [r.randint(0, 40) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
        table = token_counts.length_table(df, limits=(5, 64, 5)).collect()
        assert {x["n_tokens"] for x in table} == set(lengths) | {5, 64}
        answers = {p: x["n_tokens"] for x in table for p in x["percentiles"]}
        assert answers == {p: sorted(lengths)[-(-p * n // 100) - 1] for p in range(1, 101)}
        for x in table:
            assert x["tokens_truncated"] == sum(min(x["n_tokens"], y) for y in lengths)
            assert x["docs_cut"] == sum(y > x["n_tokens"] for y in lengths) and x["n_docs"] == lengths.count(x["n_tokens"])
    assert token_counts.length_table(df.limit(0), limits=(5,)).count() == 0
