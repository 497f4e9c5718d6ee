"""Tab-separated tables embedded in Markdown files, with a declared row count to honour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.text import strip_text
from accordant.functions.times import parse_ts
from accordant.session import fact_join, number_rows

# Fixed values.
COMPANY_HEADER = "公司名称"
TITLE_HEADERS = ("招聘岗位", "岗位名称")
TIME_PATTERNS = (r"(?U)快照时间：\s*(.+)$", r"(?U)文件日期：\s*(.+)$")
COUNT_PATTERNS = (r"(?U)全量记录数：\s*([\d,]+)", r"(?U)页面显示记录数：\s*([\d,]+)")
COMMENTS = ("<!-- DATA_START -->", "<!-- DATA_END -->")
FENCE = "~~~"
STRICT_HEADER = "序号\t公司名称\t"
HEAD_LINES = 60


def read_embedded_table(
    spark: SparkSession,
    path: str,
    company_header: str = COMPANY_HEADER,
    title_headers: Sequence[str] = TITLE_HEADERS,
    time_patterns: Sequence[str] = TIME_PATTERNS,
    count_patterns: Sequence[str] = COUNT_PATTERNS,
    on_mismatch: str = "quarantine",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, meta) of every file under the path.

    Lines are numbered across tasks; the header and the closing fence of each file are small
    aggregates joined back, so one large file is not confined to one task. `on_mismatch='fail'`
    is the strict form: fixed header start, first column as the record id, no width mismatch.
    """
    strict = on_mismatch == "fail"
    lines = number_rows(
        spark.read.text(path).select(
            F.regexp_replace("value", "^﻿", "").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        ),
        [F.col("_block"), F.col("_mid")],
        name="line_number",
        group="file",
    ).drop("_block", "_mid")
    cells = F.split("value", "\t")
    if strict:
        is_header = F.col("value").startswith(STRICT_HEADER)
    else:
        is_header = F.array_contains(cells, company_header) & F.arrays_overlap(
            cells, F.array(*[F.lit(t) for t in title_headers])
        )
    lines = lines.withColumn("is_header", is_header & F.col("value").contains("\t"))
    headers = (
        lines.filter("is_header")
        .groupBy("file")
        .agg(F.min(F.struct("line_number", F.split("value", "\t").alias("header"))).alias("h"))
        .select("file", F.col("h.line_number").alias("header_line"), "h.header")
    )
    fences = (
        lines.filter(F.col("value").startswith(FENCE))
        .join(headers, "file")
        .filter(F.col("line_number") > F.col("header_line"))
        .groupBy("file")
        .agg(F.min("line_number").alias("end_line"))
    )
    frames = headers.join(fences, "file", "left")
    body = (
        fact_join(lines, frames, ["file"], "inner")
        .filter(F.col("line_number") > F.col("header_line"))
        .filter(F.col("line_number") < F.coalesce("end_line", F.lit((1 << 62))))
        .filter(~F.col("is_header") & ~F.col("value").isin(*COMMENTS))
    )
    if not strict:
        body = body.filter(F.col("value") != "")
    body = body.withColumn("cells", F.split("value", "\t"))
    fits = F.size("cells") == F.size("header")
    rows = body.filter(fits).select(
        "file",
        "line_number",
        F.map_from_arrays("header", "cells").alias("raw"),
        *([F.get("cells", F.lit(0)).alias("record_id")] if strict else []),
    )
    quarantine = body.filter(~fits).select(
        "file",
        "line_number",
        F.size("cells").alias("column_count"),
        F.size("header").alias("expected_column_count"),
    )
    head = lines.filter(F.col("line_number") <= HEAD_LINES)
    times = [parse_ts(strip_text(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))) for p in time_patterns]
    counts = [
        F.try_to_number(
            F.nullif(F.replace(F.regexp_extract("value", p, 1), F.lit(","), F.lit("")), F.lit("")),
            F.lit("999999999999999999"),
        ).cast("long")
        for p in count_patterns
    ]
    found = head.groupBy("file").agg(
        F.min_by(F.coalesce(*times), F.when(F.coalesce(*times).isNotNull(), F.col("line_number"))).alias("snapshot_at"),
        F.min_by(F.coalesce(*counts), F.when(F.coalesce(*counts).isNotNull(), F.col("line_number"))).alias("declared"),
    )
    sizes = body.groupBy("file").agg(F.count_if(fits).alias("parsed"), F.count_if(~fits).alias("rejected"))
    meta = (
        found.join(headers, "file", "left")
        .join(sizes, "file", "left")
        .select(
            "file",
            "snapshot_at",
            "declared",
            "header",
            F.coalesce("parsed", F.lit(0)).alias("parsed"),
            F.coalesce("rejected", F.lit(0)).alias("rejected"),
        )
        .withColumn(
            "error",
            F.when(F.col("header").isNull(), "header_missing")
            .when(F.lit(strict) & (F.col("rejected") > 0), "width_mismatch")
            .when(F.col("declared") != F.col("parsed") + F.col("rejected"), "count_mismatch"),
        )
    )
    return rows, quarantine, meta


def require_complete(meta: DataFrame) -> None:
    """Fail the load if any file is not complete."""
    bad = meta.filter(F.col("error").isNotNull()).select("file", "error").take(5)
    if bad:
        raise ValueError("; ".join(f"{row['error']}: {row['file']}" for row in bad))
