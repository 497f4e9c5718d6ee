"""Delimited supplier tables: every cell is text, broken lines are set aside."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.session import number_rows

SAMPLE_CHARS = 8192
CANDIDATES = ",\t;"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Guess the separator from the first characters of one file; all files of a load share it."""
    first = spark.read.text(path).inputFiles()[:1]
    lines = spark.read.text(first).select(F.substring("value", 1, SAMPLE_CHARS)).take(SAMPLE_CHARS) if first else []
    sample = "\n".join(row[0] for row in lines)[:SAMPLE_CHARS].lstrip("﻿")
    try:
        return csv.Sniffer().sniff(sample, delimiters=CANDIDATES).delimiter
    except csv.Error:
        return "\t" if "\t" in sample else ","


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows and quarantine of one or many files with the same header; another header is an error.

    Rows carry `file` and a 1-based `row_number` per file. Quoted line breaks need `multi_line`,
    which reads a file in one task; switch it off for files too large for that.
    """
    sep = sep or sniff_separator(spark, path)
    options = {
        "header": "true", "sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8",
        "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "enforceSchema": "false",
        "nullValue": "\u0001", "emptyValue": "", "columnNameOfCorruptRecord": "_corrupt",
    }
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    frame = spark.read.options(**options).schema(schema).csv(path)
    cleaned = [" ".join(n.replace("﻿", "").replace("　", " ").split()) for n in names]
    located = frame.select(
        *[F.col(f"`{old}`").alias(new) for old, new in zip(names, cleaned)],
        "_corrupt",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    numbered = number_rows(located, [F.col("_block"), F.col("_mid")], group="file").drop("_block", "_mid")
    # Short lines are padded; only lines with surplus cells cannot be mapped.
    surplus = F.col("_corrupt").isNotNull() & F.col(f"`{cleaned[-1]}`").isNotNull()
    rows = numbered.filter(~surplus).drop("_corrupt")
    quarantine = numbered.filter(surplus).select("file", "row_number", F.col("_corrupt").alias("line"))
    return rows, quarantine
