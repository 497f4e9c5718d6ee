"""Landed files and canonical records. Files are written from whole tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import ingest as I
from accordant.plans import workspace as W
from accordant.plans.q_entities import part_record
from accordant.plans.registry import Tables, query, shared
from accordant.session import number_rows, scratch_path
from accordant.sources import delimited, embedded, paged, store, texts
from accordant.sources.sinks import publish_views

PART_ALIASES = {
    **{f: (f,) for f in R.FIELD_ALIASES},
    "company": ("P BRAND ", "p_brand"),
    "title": ("none", "p_name"),
    "recruitment_type": ("p_type",),
    "cities": ("p_size",),
    "source_record_id": ("p_partkey",),
}


def part_text(t: Tables) -> DataFrame:
    """Parts as text cells under supplier headers."""
    return t.part.select(
        F.col("p_partkey").cast("string").alias("记录ID"),
        F.col("p_brand").alias("公司名称"),
        F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("招聘岗位"),
        F.col("p_size").cast("string").alias("工作 城市"),
    )


@query(
    "a1_read_delimited",
    """SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_brand AS company, p_name || ', "' || p_type || '"' AS title, CAST(p_size AS VARCHAR) AS city FROM part""",
)
def a1(t: Tables) -> DataFrame:
    """Parts written as a delimited table and read back as text."""
    path = scratch_path(t.spark, "delimited")
    part_text(t).write.options(header="true", sep=";", escape='"').csv(path)
    rows, _ = delimited.read_delimited(t.spark, path)
    mapping = I.resolve_mapping([c for c in rows.columns if c not in ("file", "row_number")])
    return I.map_columns(rows, mapping).select(
        F.col("source_record_id").alias("record_id"), "company", "title", F.col("cities").alias("city")
    )


def landed_markdown(t: Tables) -> str:
    """One Markdown file per brand: declared count, header, rows, and some lines of wrong width."""
    path = scratch_path(t.spark, "markdown")
    row = F.concat_ws(
        "\t", F.col("p_partkey").cast("string"), "p_brand", "p_name", F.when(F.col("p_size") == 1, F.lit("surplus"))
    )
    rows = t.part.select("p_brand", F.lit(5).alias("place"), F.col("p_partkey").alias("n"), row.alias("value"))
    head = t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select(
        "p_brand",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("place"), F.lit("- 快照时间： 2024-01-02T03:04:05").alias("value")),
                F.struct(F.lit(2).alias("place"), F.concat(F.lit("- 全量记录数："), F.col("n").cast("string")).alias("value")),
                F.struct(F.lit(3).alias("place"), F.lit("~~~text").alias("value")),
                F.struct(F.lit(4).alias("place"), F.lit("序号\t公司名称\t招聘岗位").alias("value")),
                F.struct(F.lit(6).alias("place"), F.lit("~~~").alias("value")),
                F.struct(F.lit(7).alias("place"), F.lit("0\tafter\tthe end").alias("value")),
            )
        ).alias("l"),
    ).select("p_brand", "l.place", F.lit(0).cast("long").alias("n"), "l.value")
    lines = rows.unionByName(head).repartition("p_brand").sortWithinPartitions("p_brand", "place", "n")
    lines.select("p_brand", "value").write.partitionBy("p_brand").text(path)
    return path


@query(
    "a2_read_embedded_table",
    "SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_brand AS company, p_name AS title FROM part WHERE p_size <> 1",
)
def a2(t: Tables) -> DataFrame:
    """Rows of the embedded tables that fit their header."""
    rows, _, _ = embedded.read_embedded_table(t.spark, landed_markdown(t))
    return rows.select(
        F.col("raw")["序号"].alias("record_id"), F.col("raw")["公司名称"].alias("company"), F.col("raw")["招聘岗位"].alias("title")
    )


@query(
    "a2_embedded_meta",
    """SELECT p_brand AS brand, count(*) AS declared, count(*) FILTER (WHERE p_size <> 1) AS parsed, count(*) FILTER (WHERE p_size = 1) AS rejected,
       CAST(NULL AS VARCHAR) AS error, TIMESTAMP '2024-01-02 03:04:05' AS snapshot_at FROM part GROUP BY 1""",
)
def a2_meta(t: Tables) -> DataFrame:
    """Declared and found rows per embedded table."""
    _, _, meta = embedded.read_embedded_table(t.spark, landed_markdown(t))
    brand = F.url_decode(F.regexp_extract("file", "p_brand=([^/]+)", 1))
    return meta.select(F.url_decode(brand).alias("brand"), "declared", "parsed", "rejected", "error", "snapshot_at")


@query(
    "a2b_strict_embedded",
    "SELECT p_brand AS brand, CASE WHEN count(*) FILTER (WHERE p_size = 1) > 0 THEN 'width_mismatch' END AS error FROM part GROUP BY 1",
)
def a2b(t: Tables) -> DataFrame:
    """The strict form refuses every file with a line of wrong width."""
    _, _, meta = embedded.read_embedded_table(t.spark, landed_markdown(t), on_mismatch="fail")
    return meta.select(F.url_decode(F.url_decode(F.regexp_extract("file", "p_brand=([^/]+)", 1))).alias("brand"), "error")


@query(
    "a4_read_paged_json",
    """SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS kind, json_extract_string(props, '$.k') AS k, 'u / ' || user_id AS users FROM events""",
)
def a4(t: Tables) -> DataFrame:
    """Events landed as pages of a table API and flattened to rows of text."""
    path = scratch_path(t.spark, "pages")
    fields = F.struct(
        F.struct(F.col("event_type").alias("text")).alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.array(F.struct(F.lit("u").alias("name")), F.struct(F.col("user_id").cast("string").alias("name"))).alias("users"),
    )
    item = F.struct(F.col("event_id").cast("string").alias("record_id"), fields.alias("fields"))
    page = F.struct(F.array(item).alias("items"), F.lit(False).alias("has_more"))
    t.events.select(F.lit(0).alias("code"), page.alias("data")).write.json(path)
    rows = paged.flatten_records(paged.page_records(paged.read_pages(t.spark, path, multi_line=False)))
    raw = F.col("raw")
    return rows.select(
        raw[paged.RECORD_ID_HEADER].alias("record_id"), raw["kind"].alias("kind"), raw["k"].alias("k"), raw["users"].alias("users")
    )


@query(
    "a5_check_paged_load",
    """SELECT 'record_id_missing' AS code, CAST(event_id AS VARCHAR) AS detail FROM events WHERE value < 1
       UNION ALL SELECT 'record_id_repeated', 'u' || user_id FROM events WHERE value >= 1 GROUP BY user_id HAVING count(*) > 1
       UNION ALL SELECT 'fields_not_object', CASE WHEN value < 1 THEN '' ELSE 'u' || user_id END FROM events WHERE event_type = 'view' AND value > 100
       UNION ALL SELECT 'page_token_missing', CAST(event_id AS VARCHAR) FROM events WHERE value BETWEEN 2 AND 3 AND event_id < (SELECT max(event_id) FROM events)
       UNION ALL SELECT 'page_token_repeated', CAST(user_id AS VARCHAR) || event_type FROM events WHERE NOT value BETWEEN 2 AND 3 AND event_id < (SELECT max(event_id) FROM events)
         GROUP BY user_id, event_type HAVING count(*) > 1
       UNION ALL SELECT 'too_many_pages', CAST(count(*) AS VARCHAR) FROM events HAVING count(*) > 5000""",
)
def a5(t: Tables) -> DataFrame:
    """Everything wrong with a load whose pages are single events with many faults."""
    last = t.events.agg(F.max("event_id").alias("_last"))
    value = F.col("value")
    record = F.when(value < 1, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    fields = F.when((F.col("event_type") == "view") & (value > 100), "[1]").otherwise(F.col("props"))
    item = F.struct(record.alias("record_id"), F.lit(None).cast("string").alias("id"), fields.alias("fields"))
    pages = t.events.join(last, F.col("event_id") == F.col("_last"), "left").select(
        F.col("event_id").alias("page_no"), F.lit(0).alias("code"), F.array(item).alias("items"),
        F.col("_last").isNull().alias("has_more"),
        F.when(value.between(2, 3), "").otherwise(F.concat(F.col("user_id").cast("string"), "event_type")).alias("page_token"),
    )
    return paged.check_paged_load(pages, paged.page_records(pages), previous_count=1, max_pages=5000)


@query(
    "a6_store_generations",
    """SELECT 's' || l_suppkey % 5 AS source_id, 's' || l_suppkey % 5 || '-' || year(l_shipdate) AS batch_id, count(*) AS rows, max(l_shipdate) AS imported_at,
         CASE WHEN l_suppkey % 5 < 2 THEN 1 ELSE 2 END AS generation
       FROM lineitem GROUP BY ALL""",
)
def a6_generations(t: Tables) -> DataFrame:
    """Order lines stored in two loads, the second of which brings the files of the first again, and read back."""
    root = scratch_path(t.spark, "store")
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    rows = t.lineitem.select(
        F.concat_ws("-", source, F.year("l_shipdate")).alias("batch_id"), source.alias("source_id"), "l_orderkey", "l_linenumber", "l_shipdate"
    )
    offered = rows.groupBy("batch_id", "source_id").agg(F.max("l_shipdate").alias("imported_at")).withColumns(
        {"file_hash": F.sha2("batch_id", 256), "mapping": F.create_map(F.lit("id"), F.lit("l_orderkey"))}
    )
    early = F.col("source_id") < "s2"
    store.write_batch(rows.filter(early), offered.filter(early), root)
    store.write_batch(rows, offered, root)
    loads = store.committed_loads(t.spark, root)
    found = [
        store.read_committed(t.spark, root, table, [load]).withColumn("generation", F.lit(k))
        for table in (store.RAW, store.BATCHES) for k, load in enumerate(loads, 1)
    ]
    raw, batches = (found[k].unionByName(found[k + 1]) for k in (0, 2))
    sizes = raw.groupBy("source_id", "batch_id", "generation").agg(F.count("*").alias("rows"))
    return sizes.join(batches.select("batch_id", "generation", "imported_at"), ["batch_id", "generation"]).select(
        "source_id", "batch_id", "rows", "imported_at", "generation"
    )


@query(
    "a7_sample_snapshot",
    """SELECT raw_id FROM (SELECT raw_id, row_number() OVER (PARTITION BY batch_id ORDER BY raw_id) AS rn FROM raw) WHERE rn <= 5""",
    ("raw",),
)
def a7(t: Tables) -> DataFrame:
    """The first five rows of every batch."""
    numbered = number_rows(W.raw(t), [F.col("raw_id").asc()], group="batch_id")
    offered = W.batches(t).withColumn("file_hash", F.sha2("batch_id", 256))
    kept, _ = store.sample_snapshot(numbered, offered, 5)
    return kept.select("raw_id")


@query(
    "a10_publish_views",
    """SELECT 'sources' AS view, CAST(source_id AS VARCHAR) AS id, name AS label FROM sources UNION ALL SELECT 'batches', batch_id, CAST(row_count AS VARCHAR) FROM batches""",
    ("sources", "batches"),
)
def a10(t: Tables) -> DataFrame:
    """Serving views written as one bundle and read back."""
    path = scratch_path(t.spark, "views")
    publish_views({"sources": W.sources(t), "batches": W.batches(t)}, path)
    sources = t.spark.read.schema("source_id long, name string").json(f"{path}/sources")
    batches = t.spark.read.schema("batch_id string, row_count long").json(f"{path}/batches")
    return sources.select(F.lit("sources").alias("view"), F.col("source_id").cast("string").alias("id"), F.col("name").alias("label")).unionByName(
        batches.select(F.lit("batches").alias("view"), F.col("batch_id").alias("id"), F.col("row_count").cast("string").alias("label"))
    )


@query("a11_read_text_docs", "SELECT CAST(item_id AS VARCHAR) AS item, md5(text || chr(10)) AS digest FROM benchmark")
def a11(t: Tables) -> DataFrame:
    """Every benchmark passage landed as its own file and read back as a text."""
    path = scratch_path(t.spark, "texts")
    t.benchmark.select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    docs = texts.read_text_docs(t.spark, path)
    return docs.select(F.regexp_extract("doc_id", "item_id=([0-9]+)", 1).alias("item"), F.md5("text").alias("digest"))


@query(
    "b1_map_columns",
    "SELECT p_brand AS company, p_name AS title, CAST(p_size AS VARCHAR) AS cities, p_type AS recruitment_type, CAST(p_partkey AS VARCHAR) AS source_record_id, '' AS notes FROM part",
)
def b1(t: Tables) -> DataFrame:
    """Parts under canonical names by header alias, with one override."""
    mapping = I.resolve_mapping(t.part.columns, {**PART_ALIASES, "cities": ("none",)}, {"cities": "p_size"})
    mapped = I.map_columns(t.part, mapping, PART_ALIASES)
    return mapped.select("company", "title", "cities", "recruitment_type", "source_record_id", "notes")


shared(
    "page_records",
    r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url, norm FROM norm JOIN pages USING (page_id, url)""",
    "norm",
)


def page_rows(t: Tables) -> DataFrame:
    """Pages as supplier rows: title, languages as cities, and their address."""
    return I.pack_raw(
        t.pages.select(
            F.col("page_id").alias("row_number"),
            F.regexp_extract("url", "//([^/]+)/", 1).alias("公司名称"),
            F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("岗位名称"),
            F.concat(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("、x/x")).alias("城市"),
            F.concat(F.lit("见 <"), "url", F.lit(">")).alias("申请链接"),
            F.col("page_id").cast("string").alias("序号"),
        ),
        ["公司名称", "岗位名称", "城市", "申请链接", "序号"],
    )


PAGE_HEADER = ["公司名称", "岗位名称", "城市", "申请链接", "序号"]


@query(
    "b3_canonicalize",
    r"""SELECT page_id AS row_number, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, lang || CASE WHEN lang = 'x' THEN '' ELSE ',x' END AS cities, norm AS apply_url,
        CAST(NULL AS VARCHAR) AS source_record_id, '' AS announcement_url
        FROM page_records JOIN (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages) USING (page_id)""",
    ("page_records",),
)
def b3(t: Tables) -> DataFrame:
    """Pages as canonical records; the positional number is no record id."""
    mapping = I.resolve_mapping(PAGE_HEADER, override={"source_record_id": "序号"})
    records = I.canonicalize(I.map_columns(page_rows(t), mapping, raw="raw"), mapping)
    return records.select(
        "row_number", "rec.title", F.concat_ws(",", "rec.cities").alias("cities"), "rec.apply_url", "rec.source_record_id", "rec.announcement_url"
    )


@query(
    "b4_coerce_cell",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS word FROM orders",
)
def b4(t: Tables) -> DataFrame:
    """Times and padded words as text cells."""
    from accordant.functions.text import coerce_cell

    return t.orders.select(
        "o_orderkey",
        coerce_cell(F.col("o_orderdate"), "timestamp").alias("day"),
        coerce_cell(F.concat(F.lit("　 "), "o_orderpriority", F.lit(" "))).alias("word"),
    )


@query(
    "b5_parse_status",
    """SELECT event_id, CASE WHEN value < 10 AND event_type = 'view' THEN 'REJECTED' WHEN value < 10 OR event_type = 'view' THEN 'PARTIAL' ELSE 'PARSED' END AS status,
       concat_ws(',', CASE WHEN value < 10 THEN 'company_empty' END, CASE WHEN event_type = 'view' THEN 'title_empty' END) AS errors FROM events""",
)
def b5(t: Tables) -> DataFrame:
    """Parsed, partial and rejected rows."""
    company = F.when(F.col("value") < 10, "").otherwise("c")
    status, errors = I.parse_status(company, F.when(F.col("event_type") == "view", "").otherwise("t"))
    return t.events.select("event_id", status.alias("status"), F.concat_ws(",", errors).alias("errors"))


@query(
    "b6_is_non_job_row",
    "SELECT event_id, value < 10 OR event_type = 'error' AS non_job FROM events",
)
def b6(t: Tables) -> DataFrame:
    """Rows without a company and notice rows."""
    company = F.when(F.col("value") < 10, "").when(F.col("event_type") == "error", "本表正版授权").otherwise(F.col("event_type"))
    return t.events.select("event_id", I.is_non_job_row(company).alias("non_job"))


@query(
    "b7_row_hash",
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":" ' || p_name || '","p_type":"' || p_type || '"}') AS row_hash FROM part""",
)
def b7(t: Tables) -> DataFrame:
    """Hashes of raw rows in key order, blanks included."""
    raw = F.create_map(
        F.lit("p_type"), F.col("p_type"), F.lit("p_name"), F.concat(F.lit(" "), "p_name"), F.lit("p_brand"), F.col("p_brand")
    )
    return t.part.select("p_partkey", I.row_hash(raw).alias("row_hash"))


COMPOUND = """substr(sha256('{"cities":[],"company":"' || lower(p_brand) || '","graduation_years":[],"recruitment_type":"","title":"' || lower(p_name) || '"}'), 1, 32)"""


@query(
    "b8_identity_hint",
    f"""SELECT p_partkey, CASE WHEN p_type <> 'LARGE' THEN CAST(p_partkey AS VARCHAR) WHEN p_size >= 20 THEN 'https://large.example.com/jobs/' || p_size
          WHEN p_size >= 10 THEN 'https://a.example.com/' || p_size ELSE {COMPOUND} END AS value,
        CASE WHEN p_type <> 'LARGE' THEN 'SOURCE_RECORD_ID' WHEN p_size >= 10 THEN 'OFFICIAL_URL' ELSE 'COMPOUND_HINT' END AS strength,
        p_type <> 'LARGE' OR p_size >= 10 AS stable FROM part""",
)
def b8(t: Tables) -> DataFrame:
    """The strongest identity of every part record."""
    hinted = t.part.select("p_partkey", part_record().alias("rec")).withColumn("h", I.identity_hint(F.col("rec")))
    return hinted.select("p_partkey", "h.value", "h.strength", "h.stable")


@query(
    "b9_compound_identity",
    """SELECT p_partkey, CASE WHEN p_size > 5 THEN substr(sha256('{"cities":["' || p_type || '","a"],"company":"' || lower(p_brand) || '","graduation_years":["2000","2001"],"recruitment_type":"x y","title":"'
       || lower(p_name) || '"}'), 1, 32) END AS identity FROM part""",
)
def b9(t: Tables) -> DataFrame:
    """Compound identity from all parts, none without a title."""

    def texts_of(*values: Column) -> Column:
        return F.array(*values)

    title = F.when(F.col("p_size") > 5, F.upper("p_name")).otherwise(" ")
    hint = I.compound_identity(
        F.concat("p_brand", F.lit(" 有限公司")), title, texts_of(F.concat(F.lit("a")), F.concat(F.lit(" "), F.col("p_type"))),
        F.lit(" X  y"), texts_of(F.lit("2001"), F.lit("2000")),
    )
    # Upper-case type names sort before the lower-case city.
    return t.part.select("p_partkey", hint.alias("identity"))


@query(
    "b10_preview",
    r"""SELECT count(*) AS row_count, count(*) FILTER (WHERE status <> 'REJECTED') AS success_count, count(*) FILTER (WHERE status = 'REJECTED') AS error_count,
        count(*) FILTER (WHERE company = '') AS non_job FROM (
          SELECT CASE WHEN value < 10 THEN '' ELSE 'c' END AS company, CASE WHEN value < 10 AND event_type = 'view' THEN 'REJECTED' ELSE 'x' END AS status FROM events)""",
)
def b10(t: Tables) -> DataFrame:
    """Totals of a parsed snapshot of events."""
    rows = I.pack_raw(
        t.events.select(
            F.col("event_id").alias("row_number"),
            F.when(F.col("value") < 10, "").otherwise("c").alias("公司"),
            F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("岗位"),
        ),
        ["公司", "岗位"],
    )
    parsed = I.parse_rows(rows, I.resolve_mapping(["公司", "岗位"]))
    totals, _, _ = I.preview(parsed)
    return totals.select("row_count", "success_count", "error_count", "non_job")
