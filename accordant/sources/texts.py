"""Profile texts in UTF-8 (with or without a mark) or GB18030."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import tune


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """One line per file: doc_id (path), name, text. Anything undecodable fails the read."""
    tune(spark)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "GB18030"))
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            F.col("path").alias("doc_id"),
            F.regexp_extract("path", "([^/]+)$", 1).alias("name"),
            F.regexp_replace(text, "^﻿", "").alias("text"),
        )
    )
