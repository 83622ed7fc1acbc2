"""Quality scores on rows that were not learned from."""

import random

import numpy as np
from pyspark.sql import functions as F

from longspan.llm import quality
from longspan.llm.common import held_out_row

FOLDER = "/root/testdata/sf0.01"


def test_held_out_rows_of_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels))
    joined = scored.withColumn("held", held_out_row(parts=3, held_out=1)).join(labels, "doc_id").where("held").collect()
    right = [(r["score"] >= 0.5) == (r["quality"] == 1) for r in joined]
    assert len(right) > 80 and np.mean(right) >= 0.95
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_labels_language_and_source_are_no_input(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 300")
    model = quality.fit(docs, labels)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert sorted(map(tuple, quality.score(docs, model).collect())) == sorted(map(tuple, quality.score(other, model).collect()))
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(held_out_row(parts=3, held_out=1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, turned)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_pairwise_sum_in_linear_time_equals_all_pairs():
    random_ = np.random.default_rng(1)
    model = quality.Model(np.zeros(2), np.ones(2), np.zeros((2, quality.BINS - 1)))
    model.weights, model.factors, model.bias = random_.normal(size=model.slots), random_.normal(size=(model.slots, 3)), 0.3
    slots, values, starts = random_.integers(0, model.slots, 11), random_.normal(size=11), np.array([0, 4])
    got, _ = model.logits(starts, slots, values)
    for row, (a, b) in enumerate([(0, 4), (4, 11)]):
        total = 0.3 + (model.weights[slots[a:b]] * values[a:b]).sum()
        for i in range(a, b):
            for j in range(i + 1, b):
                total += model.factors[slots[i]] @ model.factors[slots[j]] * values[i] * values[j]
        assert np.isclose(got[row], total)


def test_slices_add_up(monkeypatch):
    draw = random.Random(2)
    text = " ".join(draw.choice(["aa", "b!", "&c", "D", "9"]) for _ in range(5_000)).encode()
    [(_, whole)] = quality.measured([text])
    monkeypatch.setattr(quality, "HELD_BYTES", 1_000)
    [(_, sliced)] = quality.measured([text])
    assert np.array_equal(whole.keys, sliced.keys) and np.array_equal(whole.counts, sliced.counts)
    assert np.array_equal(whole.sums[:, 2:9], sliced.sums[:, 2:9])


def test_nulls_clashes_and_missing_classes(spark):
    rows = [(1, None, 0.1, "x"), (1, "", None, "y"), (None, "good words here. " * 9, 4.0, None), (2, "a" * 200_000, -1.0, None),
            (3, "&&& $$$ " * 50, None, None), (3, "&&& $$$ " * 50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars double, score string")
    labels = spark.createDataFrame([(3, 0), (1, 1), (2, 1), (None, 1), (9, 7)], "doc_id long, quality int")
    for given in (labels, labels.where("quality = 1"), labels.limit(0)):
        scores = quality.score(docs, quality.fit(docs, given)).collect()
        assert sorted(str(r["doc_id"]) for r in scores) == ["1", "1", "2", "3", "3", "None"]
        assert all(0 <= r["score"] <= 1 for r in scores)
    assert quality.fit(docs, labels.limit(0)) == 0.5
    assert quality.score(docs.limit(0), 0.5).count() == 0
    assert quality.score(docs.drop("n_chars"), quality.fit(docs, labels)).count() == 6
