"""A training corpus from raw documents: five stages, each written and read again before the next.

run(spark, sf_dir) applies STAGES to documents. Each stage takes (spark, docs, sf_dir), works on
all documents that the one before it kept, and returns the documents it keeps, with the columns
of documents; the last returns the pieces of packed sequences with their ids.

Cases: each stage is an operator of accordant.llm and treats nulls, empty texts, ties, repeated rows,
empty tables and further columns as that operator says. A null text fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm import decontaminate, near_copies, packing, quality_rules, secret_scan
from accordant.llm.queries import table, tokenizer
from accordant.session import scratch_path

SHINGLE = 5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed limits nor the learned rules reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a shingle similarity of 0.8 or more, that with the smallest id."""
    return near_copies.keep_one_of_each_group(docs, width=SHINGLE)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word run of the benchmark."""
    return decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality rules", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Learned rules, fingerprints and packing are beyond SQL: tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
