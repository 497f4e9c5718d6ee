"""Landed pages of a table API: JSON files with nested cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.text import let

PAGE_SCHEMA = (
    "code int, data struct<items: array<struct<record_id: string, id: string, fields: string>>, "
    "has_more: boolean, page_token: string>"
)
# Fixed values.
CELL_KEYS = ("link", "url", "text", "name", "en_name", "email")
TRUE_TEXT, FALSE_TEXT = "是", "否"
RECORD_ID_HEADER = "记录ID"
MAX_PAGES = 10000


def flatten_cell(value: Column) -> Column:
    """Display text of one nested cell held as a VARIANT, at any depth.

    Lists join their non-empty members, objects show the first of the usual text keys, or their JSON. Since the
    text of a list is that of its members in turn, a cell is taken apart level by level: every step puts
    lists in the place of their members and objects in that of their member, as often as the cell is deep. What
    can't be taken apart becomes a text at once, which later steps only pass on; empty texts are left out.
    """
    step = lambda parts, _: F.flatten(F.transform(parts, lambda p: F.when(p["shown"].isNotNull(), F.array(p)).otherwise(_opened(p["cell"]))))
    parts = F.aggregate(F.sequence(F.lit(0), _depth(value)), F.array(_part(value)), step)
    return F.array_join(F.transform(parts, lambda p: p["shown"]), " / ")


def _part(cell: Column | None = None, shown: Column | None = None) -> Column:
    """A cell that is still to be taken apart, or the text of one that can't be."""
    null = F.lit(None)
    return F.struct((null.cast("variant") if cell is None else cell).alias("cell"), (null.cast("string") if shown is None else shown).alias("shown"))


def _depth(value: Column) -> Column:
    """How deep lists and objects are nested in a cell."""
    # Escapes stand in texts only; without them a text ends at the next quote. Brackets outside of texts remain.
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.to_json(value), F.lit("")), r"\\.", ""), r'"[^"]*"|[^\[\]{}"]+', "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), zero, walk)["most"]


def _opened(cell: Column) -> Column:
    """The members of a list, the chosen member of an object, else the cell's text unless it is empty."""

    def other(fields: Column) -> Column:
        chosen = F.coalesce(*[_filled(F.try_element_at(fields, F.lit(key))) for key in CELL_KEYS])
        text = let(_leaf_text(cell), lambda x: F.when(x != "", F.array(_part(shown=x))).otherwise(F.array().cast("array<struct<cell:variant,shown:string>>")))
        return let(F.when(fields.isNotNull(), chosen), lambda c: F.when(c.isNotNull(), F.array(_part(c))).otherwise(text))

    return let(
        F.try_variant_get(cell, "$", "array<variant>"),
        lambda members: F.when(members.isNotNull(), F.transform(members, lambda m: _part(m))).otherwise(
            let(F.try_variant_get(cell, "$", "map<string,variant>"), other)
        ),
    )


def _leaf_text(cell: Column) -> Column:
    plain = F.try_variant_get(cell, "$", "string")
    return let(
        F.schema_of_variant(cell),
        lambda shape: F.when(shape.isNull() | (shape == "VOID"), "")
        .when(shape == "BOOLEAN", F.when(plain == "true", TRUE_TEXT).otherwise(FALSE_TEXT))
        .when(shape.startswith("OBJECT"), F.coalesce(F.to_json(cell), F.lit("")))
        .otherwise(plain),
    )


def _filled(member: Column) -> Column:
    """A member of an object unless it is absent, null or an empty text."""

    def keep(m: Column) -> Column:
        empty = F.coalesce(F.is_variant_null(m), F.lit(True)) | F.coalesce(F.try_variant_get(m, "$", "string") == "", F.lit(False))
        return F.when(m.isNotNull() & ~empty, m)

    return let(member, keep)


def read_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One line per landed page; the page number is the last number in the file name.

    Files with one page per line (`multi_line=False`) are read in splits.
    """
    return (
        spark.read.schema(PAGE_SCHEMA)
        .option("multiLine", str(multi_line).lower())
        .json(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.try_to_number(F.regexp_extract("_metadata.file_path", r"(\d+)\D*$", 1), F.lit("999999999"))
            .cast("long")
            .alias("page_no"),
            F.coalesce("code", F.lit(0)).alias("code"),
            F.col("data.items").alias("items"),
            F.coalesce("data.has_more", F.lit(False)).alias("has_more"),
            F.trim(F.coalesce("data.page_token", F.lit(""))).alias("page_token"),
        )
    )


def page_records(pages: DataFrame) -> DataFrame:
    """One line per record: page_no, record_id, fields as JSON text."""
    item = F.explode("items").alias("item")
    return pages.select("page_no", item).select(
        "page_no",
        F.trim(F.coalesce(F.nullif("item.record_id", F.lit("")), "item.id", F.lit(""))).alias("record_id"),
        F.col("item.fields").alias("fields"),
    )


def flatten_records(records: DataFrame, id_field: str = RECORD_ID_HEADER) -> DataFrame:
    """Records with `raw`, a text map that also holds the injected record id."""
    parsed = records.withColumn("_v", F.expr("try_cast(try_parse_json(fields) as map<string, variant>)"))
    cells = F.transform_values("_v", lambda _, v: flatten_cell(v))
    rest = F.map_filter(cells, lambda k, _: k != id_field)
    return parsed.select(
        "page_no", "record_id", F.map_concat(F.create_map(F.lit(id_field), "record_id"), rest).alias("raw")
    )


def paged_header(rows: DataFrame, id_field: str = RECORD_ID_HEADER) -> list[str]:
    """Column names over all records, the id first. There are as many as the table has columns."""
    names = rows.select(F.explode(F.map_keys("raw")).alias("k")).distinct()
    found = [r["k"] for r in names.collect()]
    return [id_field, *sorted((n for n in found if n != id_field), key=str.casefold)]


def read_paged_json(
    spark: SparkSession, path: str, id_field: str = RECORD_ID_HEADER, multi_line: bool = True
) -> tuple[DataFrame, list[str]]:
    rows = flatten_records(page_records(read_pages(spark, path, multi_line)), id_field)
    return rows, paged_header(rows, id_field)


def check_paged_load(
    pages: DataFrame, records: DataFrame, previous_count: int = 0, max_pages: int = MAX_PAGES
) -> DataFrame:
    """Everything that makes a load incomplete, as (code, detail). Empty means complete."""

    def rows(df: DataFrame, code: str, detail: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))

    more = pages.filter("has_more")
    totals = pages.agg(
        F.count("*").alias("pages"),
        F.max("page_no").alias("last"),
        F.max(F.when(~F.col("has_more"), F.col("page_no"))).alias("closing"),
        F.count_if(~F.col("has_more")).alias("closings"),
        F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("rows"),
    )
    checks = [
        rows(pages.filter("code <> 0"), "api_error", F.col("page_no")),
        rows(pages.filter(F.col("items").isNull()), "items_missing", F.col("page_no")),
        rows(records.filter("record_id = ''"), "record_id_missing", F.col("page_no")),
        rows(
            records.filter("record_id <> ''").groupBy("record_id").count().filter("count > 1"),
            "record_id_repeated",
            F.col("record_id"),
        ),
        rows(
            records.filter(~F.coalesce(F.ltrim("fields").startswith("{"), F.lit(False))),
            "fields_not_object",
            F.col("record_id"),
        ),
        rows(more.filter("page_token = ''"), "page_token_missing", F.col("page_no")),
        rows(
            more.filter("page_token <> ''").groupBy("page_token").count().filter("count > 1"),
            "page_token_repeated",
            F.col("page_token"),
        ),
        rows(totals.filter(F.col("pages") > max_pages), "too_many_pages", F.col("pages")),
        rows(
            totals.filter((F.col("closings") != 1) | (F.col("closing") != F.col("last"))),
            "last_page_missing",
            F.col("last"),
        ),
        rows(
            totals.filter((F.coalesce("rows", F.lit(0)) == 0) & (F.lit(previous_count) > 0)),
            "empty_after_rows",
            F.lit(previous_count),
        ),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
