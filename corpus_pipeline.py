"""From raw documents to packed training sequences: quality, near-dedup, decontamination, redaction, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amtskompass.llm import crf, inverted, packing, quality, simhash

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHINGLE, SIMILARITY = 5, 0.8
ORACLE_SQL = None  # expectation-maximisation, components and the field have no SQL form; tests/llm compares with plain Python


def _rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are among ``keys`` (``doc_id``, ``text_hash``)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # columns of the input are packed away, whatever their names
    marked = docs.select(row).withColumn("key", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash")))
    return marked.join(keys.select(F.struct("doc_id", "text_hash").alias("key")), "key", "left_semi").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _rows_of(docs, quality.judged(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.first_of_each(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows_of(docs, inverted.contamination(docs, items).where("not contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return crf.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what the others keep is written to the shared folder and read again."""
    folder = f"{inverted.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
