"""Exports. Files are written by the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import display_list, formula_safe
from accordant.rules import EXPORT_COLUMNS
from accordant.session import number_rows

# Title and labels of the Markdown export.
MARKDOWN_TITLE = "# 可信投递短名单"
MARKDOWN_LABELS = (
    ("城市", "cities"),
    ("可投性", "eligibility"),
    ("经历证据", "evidence_fit"),
    ("信息可信度", "trust"),
    ("投递阶段", "application_stage"),
    ("下一步", "next_action"),
    ("计划时间", "next_action_at"),
    ("官网", "apply_url"),
    ("备注", "note"),
)


def export_rows(shortlist: DataFrame) -> DataFrame:
    """The ready rows with the fixed export columns, all text except the priority."""
    def column(name: str):
        if name == "priority":
            return F.coalesce("priority", F.lit(0)).alias(name)
        if name == "cities":
            return display_list(F.col("cities")).alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return shortlist.filter("ready").select(*[column(n) for n in EXPORT_COLUMNS], "entity_id", "added_at")


def csv_rows(rows: DataFrame) -> DataFrame:
    """Rows as they go into a spreadsheet: no cell can start a formula."""
    types = dict(rows.dtypes)
    return rows.select(
        *[
            (formula_safe(F.col(c)) if types[c] == "string" else F.col(c)).alias(c)
            for c in EXPORT_COLUMNS
        ]
    )


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a byte-order mark in front of the header of every file."""
    ready = csv_rows(rows)
    first = ready.columns[0]
    (
        ready.withColumnRenamed(first, "﻿" + first)
        .write.mode("overwrite")
        .options(header="true", escape='"', emptyValue="", encoding="UTF-8")
        .csv(path)
    )


def export_json(rows: DataFrame, path: str) -> None:
    rows.select(*EXPORT_COLUMNS).write.mode("overwrite").json(path)


def markdown_sections(rows: DataFrame) -> DataFrame:
    """One numbered section per row, in shortlist order."""
    order = [F.col("priority").desc(), F.col("added_at").asc_nulls_last(), F.col("entity_id").asc()]
    numbered = number_rows(rows, order, name="position")
    lines = [
        F.concat(F.lit("## "), F.col("position").cast("string"), F.lit(". "), "company", F.lit("｜"), "title"),
        F.lit(""),
        *[F.concat(F.lit(f"- {label}："), F.col(name)) for label, name in MARKDOWN_LABELS],
        F.lit(""),
    ]
    heading = F.when(F.col("position") == 1, F.lit(MARKDOWN_TITLE + "\n\n")).otherwise("")
    return numbered.select("position", F.concat(heading, F.concat_ws("\n", *lines)).alias("value"))


def export_markdown(rows: DataFrame, path: str) -> None:
    """Text files that read in section order."""
    (
        markdown_sections(rows)
        .repartitionByRange("position")
        .sortWithinPartitions("position")
        .select("value")
        .write.mode("overwrite")
        .text(path)
    )


def publish_views(views: Mapping[str, DataFrame], path: str) -> None:
    """Write every serving view as JSON under one folder."""
    for name, view in views.items():
        view.write.mode("overwrite").json(f"{path}/{name}")
