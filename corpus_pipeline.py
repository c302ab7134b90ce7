"""Cleaning a corpus: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the
pieces of packed sequences. Documents without an id pass the filters, as nothing can reject them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import written
from kindred.llm.neardup import near_duplicates
from kindred.llm.packing import pack_documents
from kindred.llm.pii import pseudonymize
from kindred.llm.quality import classify
from kindred.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs but those whose id has only rejections."""
    out = decisions.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    return docs.select(*COLUMNS).join(out.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return _without(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more."""
    return _without(docs, near_duplicates(docs, size=5, percent=80))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold."""
    out = remove_repeats(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers and dates."""
    return pseudonymize(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces packed into sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near), ("repeated_passages", passages), ("pseudonyms", private), ("packing", sequences)]
ORACLE_SQL = None  # the stages are tested against brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
