"""The pipeline on a small corpus and beside its decisions written plainly."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from longspan.llm import mixing

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "shards":
            assert docs.columns == COLUMNS
        docs = docs.cache()
        counts.append(docs.count())
        if name == "near copies":
            normal = [" ".join(r["text"].split()) for r in docs.collect()]
            assert len(normal) == len(set(normal))
    assert counts[0] * 0.9 < counts[3] <= counts[2] <= counts[1] <= counts[0]
    assert counts[4] == counts[5] > counts[3]
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_benchmark_stage_keeps_clean_rows_of_the_same_id(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {passage}"), (None, "clean one"), (None, None), (7, f"{passage} b"), (7, "clean two"), (8, passage), (9, "clean three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "clean one", "clean three", "clean two"]


def test_language_stage_keeps_mixed_documents(spark):
    words = {"aa": "the and with house", "bb": "der und mit schloß", "cc": "дом река это город"}
    rows = [(i, " ".join([w] * 5), k) for i, (k, w) in enumerate(list(words.items()) * 20)]
    mixed = " ".join(f"{w} {w} {w}" for w in words.values())
    docs = spark.createDataFrame([*rows, (100, mixed, None), (101, "12 - 34", None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} | {100}


def test_language_stage_carries_columns_of_any_name(spark):
    rows = [(i, "the and with house " * 4, "aa", 1.5, "kept") for i in range(40)] + [(50, "12", None, 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    out = pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.where("doc_id < 50").collect())


def test_mix_stage_keeps_to_the_budget_with_repeated_ids(spark):
    rows = [(7, f"{a} b c d", "s") for a in "efghijkl"] + [(None, "one two", "t"), (None, "one two", "t"), (None, "two one", "t"), (3, "", "t"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times", F.lit(9))
    mixed = mixing.mix(docs, by_text=True)
    budget = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert abs(words["s"] - budget["s"]) <= 2 and abs(words["t"] - budget["t"]) <= 1
    counts = {r["text"]: r["count"] for r in out.where("source = 's'").groupBy("text").count().collect()}
    assert all(n <= 2 for n in counts.values())
