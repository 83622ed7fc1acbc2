"""From raw documents to shards of a training mix.

STAGES are applied in order, each to all rows that the one before kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm import decontamination, language, mixing, near_join, sharding
from longspan.llm.common import stored, text_of

SHARDS = 40
# Languages and scripts are learned here too; no SQL says that.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; those that mix several stay, however their letters are shared."""
    # Numbered names, so that no column of documents clashes with those of the labels.
    names = [f"kept{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = language.identify(docs.toDF(*names), language.fit(docs), text_column=text, keep=names)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies stays: that with the least id."""
    leaders = near_join.near_duplicates(docs).where("leader").select(
        F.col("doc_id").alias("leader_id"), F.col("digest").alias("leader_digest")).distinct()
    marked = docs.withColumn("digest__", F.md5(near_join.normal("text")))
    kept = marked.join(
        leaders,
        marked["doc_id"].eqNullSafe(F.col("leader_id")) & (marked["digest__"] == F.col("leader_digest")))
    return kept.dropDuplicates(["doc_id", "digest__"]).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; others of the same id, or of no id, stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, benchmark, by_text=True).select(
        F.col("doc_id").alias("found_id"), F.col("text_digest").alias("found_digest")).distinct()
    return docs.join(
        found,
        docs["doc_id"].eqNullSafe(F.col("found_id")) & (decontamination.digest("text") == F.col("found_digest")),
        "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; the one where a source's budget ends, if half or more of it is taken.

    Rows equal in id, source and text are one document, which comes as often as all of them together.
    """
    taken = mixing.mix(docs, by_text=True).select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("text_digest").alias("mix_digest"),
        F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int").alias("times"))
    often = taken.groupBy("mix_id", "mix_source", "mix_digest").agg(F.sum("times").cast("int").alias("mix_times")).where("mix_times > 0")
    marked = docs.withColumn("mix_text", F.md5(text_of("text").cast("binary"))).dropDuplicates(["doc_id", "source", "mix_text"])
    joined = marked.join(
        often,
        marked["doc_id"].eqNullSafe(F.col("mix_id")) & marked["source"].eqNullSafe(F.col("mix_source"))
        & (marked["mix_text"] == F.col("mix_digest")))
    return joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; shards' row counts differ by one at most."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("shards", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
