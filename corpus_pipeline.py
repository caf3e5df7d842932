"""A corpus pipeline of five stages over ``documents``; each reads what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``, extra ones too. Null texts and ids, repeated rows and
empty tables are treated as the operators define it; a stage never fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, decontamination, ngram_jaccard, quality, secrets, skew
from strandframe.llm.queries import vocabulary_path
from strandframe.session import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id (null last), and of the smallest hash of id
    and text among rows of one id; of wholly equal rows one. Rows without words are in no group and all stay.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = cut(ngram_jaccard.jaccard_components(docs.select("doc_id", "text", key.alias("__key")), key_col="__key").filter("n_shingles > 0"))
    first = cut(found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("m")))
    gone = skew.join_groups(found, first, "group", found.count()).filter("key != first.key").select(F.col("key").alias("__gone")).distinct()
    again = cut(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("__again")))
    kept = docs.withColumn("__key", key).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    if not again.isEmpty():  # rows that are repeated: only those are shuffled
        several = kept.join(again, F.col("__key") == F.col("__again"), "left_semi").dropDuplicates(["__key"])
        kept = kept.join(again, F.col("__key") == F.col("__again"), "left_anti").unionByName(several)
    return kept.select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; n_chars follows where the text changed."""
    out = secrets.redacted(docs.withColumn("__was", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__was"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Training a classifier, compression and BPE merges can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
