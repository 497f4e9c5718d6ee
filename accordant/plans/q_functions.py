"""Column functions over page addresses, titles, texts and order attributes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions import classify, similarity, text, times, url
from accordant.plans import workspace as W
from accordant.plans.registry import Tables, query, shared
from accordant.sources.paged import flatten_cell

# Rule sets for the driver's invented data, in the same shape as the default ones.
PAGE_IDS = dataclasses.replace(
    R.IdRules(),
    text_pattern=r"(?iU)page\s*no\s*[:：]?\s*([A-Za-z0-9_-]{3,})",
    containers=("en", "fr", "de"),
    unsafe_segments=("es",),
    query_keys=("page",),
    context_query_keys=("ref",),
    min_length=2,
    broad_url_markers=("9",),
    generic_terminals=("home", "100"),
)
PAGE_KINDS = R.KindRules(
    broad_markers=("aux", "tion and"),
    role_suffixes=("er", "ing"),
    counted_suffixes="er|ing",
    family_pattern="ent|(?<!t)ion",
    role_signals="on|er|re|an",
    category_signals="ou|ai|ei",
    unit_suffix="that.",
    separators="[|,.]+",
)
PAGE_SCOPES = R.ScopeRules(
    aggregators=("spam-farm.example.org", "example.net"),
    shared_hosts=("cheap-pills.example.com",),
    shared_parents=("example.com",),
    infrastructure_pattern=r"^blog\.th[a-z]+\.example\.com$",
    public_suffixes=("com", "net", "org", "example.org"),
)
PAGE_TITLES = R.TitleRules(
    roles=(("nation", "(?iu)tion"), ("ring", "ing[^.]{0,12}er"), ("state", "re|an")),
    industries=(("french", "(?U)ou|eau"), ("german", "sch|ei")),
    default="other",
    family_pattern="er|on",
    separator_pattern="[,.;]",
    repeated=("aux", "th"),
    trim_chars=" .*%#",
    min_families=6,
    min_repeats=4,
    min_separators=3,
    long_title=70,
)
WORDS = {"article": ("the", "la", "der"), "joint": ("and", "et", "und"), "stem": ("tion", "ment"), "none": ("zzz",)}


def titled(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


shared("titled", "SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages")
shared(
    "norm",
    """SELECT page_id, url, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS norm, host, path, query FROM (
       SELECT page_id, url, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme,
         regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
       FROM pages)""",
)
shared(
    "parts",
    """SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM norm""",
    "norm",
)


@query(
    "c1_clean_text",
    r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents",
)
def c1(t: Tables) -> DataFrame:
    """Whole texts with white space folded, as digests."""
    return t.documents.select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


@query("c2_extract_url", "SELECT page_id, norm AS found FROM norm", ("norm",))
def c2(t: Tables) -> DataFrame:
    """The first address inside a sentence."""
    sentence = F.concat(F.lit("见 <"), "url", F.lit("> and ftp://other"))
    return t.pages.select("page_id", url.extract_url(sentence).alias("found"))


@query("c3_normalize_url", "SELECT page_id, norm FROM norm", ("norm",))
def c3(t: Tables) -> DataFrame:
    """Comparable page addresses."""
    return t.pages.select("page_id", url.normalize_url(F.col("url")).alias("norm"))


@query(
    "c5_split_values",
    r"""SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '~') AS parts, len(list_distinct(l)) AS n FROM (
        SELECT page_id, list_filter(list_transform(regexp_split_to_array(title, '[|,.]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM titled)""",
    ("titled",),
)
def c5(t: Tables) -> DataFrame:
    """Title parts in order, without repeats."""
    parts = text.split_values(F.col("title"), "[|,.]+")
    return titled(t).select("page_id", F.array_join(parts, "~").alias("parts"), F.size(parts).alias("n"))


PLAUSIBLE = r"(regexp_full_match({0}, '[a-z0-9_-]{{2,255}}') AND NOT regexp_full_match({0}, '(19|20)[0-9]{{2}}') AND NOT regexp_matches({0}, 'campus|earlycareer|early-career|graduate|program|recruit|student'))"


@query(
    "c6_plausible_id",
    f"SELECT page_id, {PLAUSIBLE.format('lower(segs[-1])')} AS plausible FROM parts",
    ("parts",),
)
def c6(t: Tables) -> DataFrame:
    """Whether the last path segment could be a record id."""
    last = F.element_at(url.path_segments(url.normalize_url(F.col("url"))), -1)
    return t.pages.select("page_id", url.is_plausible_id(last).alias("plausible"))


shared(
    "page_ids",
    r"""SELECT page_id, CASE WHEN list_contains(segs, 'es') THEN NULL
          WHEN segs[1] IN ('en', 'fr', 'de') AND regexp_full_match(segs[2], '[A-Za-z0-9_-]{2,}') AND NOT regexp_full_match(segs[2], '(19|20)[0-9]{2}') THEN segs[2]
          ELSE NULL END AS record_id, segs, query, norm, url FROM parts""",
    "parts",
)


@query("c7_extract_record_id", "SELECT page_id, record_id FROM page_ids", ("page_ids",))
def c7(t: Tables) -> DataFrame:
    """The record id an address carries."""
    rows = titled(t)
    return rows.select("page_id", url.extract_record_id(F.col("title"), F.col("url"), rules=PAGE_IDS).alias("record_id"))


@query(
    "c8_id_matches_url",
    """SELECT page_id, coalesce(record_id IS NOT NULL, FALSE) AS own, NOT list_contains(segs, 'es') AND query LIKE '%ref=x%' AND FALSE AS other FROM page_ids""",
    ("page_ids",),
)
def c8(t: Tables) -> DataFrame:
    """Whether an address names the id it carries, and an id it does not."""
    found = url.extract_record_id(F.col("url"), rules=PAGE_IDS)
    rows = t.pages.withColumn("record_id", found)
    return rows.select(
        "page_id",
        url.id_matches_url(F.col("url"), F.col("record_id"), PAGE_IDS).alias("own"),
        url.id_matches_url(F.col("url"), F.lit("no-such-id"), PAGE_IDS).alias("other"),
    )


@query(
    "c9_is_direct_url",
    r"""SELECT page_id, coalesce(regexp_matches(lower(path), '/(en|fr|de)/[a-z0-9_-]{2,}$') AND NOT regexp_full_match(segs[-1], '20[0-9]{2}')
        AND segs[-1] NOT LIKE '%9%' AND segs[-1] NOT IN ('home', '100'), FALSE) AS direct FROM parts""",
    ("parts",),
)
def c9(t: Tables) -> DataFrame:
    """Whether an address points at one page by its shape."""
    return t.pages.select("page_id", url.is_direct_url(F.col("url"), F.lit(""), PAGE_IDS).alias("direct"))


shared(
    "role_counts",
    r"""SELECT page_id, clean, greatest(len(list_distinct(list_filter(list_transform(regexp_split_to_array(clean, '[|,.]+'), lambda x: trim(x)), lambda x: x <> ''))),
          len(regexp_extract_all(clean, 'er|ing'))) AS roles,
        len(regexp_extract_all(clean, 'ent|ion')) - len(regexp_extract_all(clean, 'tion')) AS families,
        len(regexp_extract_all(clean, 'on|er|re|an')) AS signals, len(regexp_extract_all(clean, 'ou|ai|ei')) AS categories
        FROM (SELECT page_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS clean FROM titled)""",
    "titled",
)


@query("c10_role_counts", "SELECT page_id, roles, families, signals, categories FROM role_counts", ("role_counts",))
def c10(t: Tables) -> DataFrame:
    """How many roles, families, signals and categories a title names."""
    counted = titled(t).withColumn("n", classify.role_counts(text.clean_text(F.col("title")), PAGE_KINDS))
    return counted.select("page_id", "n.roles", "n.families", "n.signals", "n.categories")


shared(
    "kinds",
    r"""SELECT r.page_id, CASE
          WHEN i.record_id IS NOT NULL AND specific AND roles <= 2 THEN 'POSTING 0.98'
          WHEN broad OR roles >= 3 OR families >= 3 OR (length(clean) >= 32 AND signals >= 4) OR categories >= 4 OR clean LIKE '%that.'
            THEN CASE WHEN i.record_id IS NOT NULL OR shaped THEN 'CAMPAIGN 0.82' ELSE 'CAMPAIGN 0.94' END
          WHEN (i.record_id IS NOT NULL OR shaped) AND clean <> '' AND specific THEN 'POSTING 0.9'
          ELSE 'POSTING 0.58' END AS outcome
        FROM (SELECT *, clean LIKE '%er%' OR clean LIKE '%ing%' AS specific, lower(clean) LIKE '%aux%' OR lower(clean) LIKE '%tion and%' AS broad FROM role_counts) r
        JOIN page_ids i ON i.page_id = r.page_id
        JOIN (SELECT page_id, coalesce(regexp_matches(lower(path), '/(en|fr|de)/[a-z0-9_-]{2,}$') AND NOT regexp_full_match(segs[-1], '20[0-9]{2}')
          AND segs[-1] NOT LIKE '%9%' AND segs[-1] NOT IN ('home', '100'), FALSE) AS shaped FROM parts) d ON d.page_id = r.page_id""",
    "role_counts", "page_ids", "parts",
)


@query("c11_classify_record", "SELECT page_id, outcome FROM kinds", ("kinds",))
def c11(t: Tables) -> DataFrame:
    """Kind and confidence of every page by its title, address and id."""
    rows = titled(t).withColumn("record_id", url.extract_record_id(F.col("url"), rules=PAGE_IDS))
    kind = classify.classify_record(
        F.col("title"), F.array().cast("array<string>"), F.col("url"), F.lit(""), F.col("record_id"), PAGE_KINDS, PAGE_IDS
    )
    judged = rows.withColumn("k", kind)
    return judged.select("page_id", F.concat_ws(" ", "k.kind", F.col("k.confidence").cast("string")).alias("outcome"))


shared(
    "scopes",
    r"""SELECT page_id, host, CASE
          WHEN host IN ('com', 'net', 'org', 'example.org') OR NOT regexp_matches(host, '\.(com|net|org)$') THEN 'public_suffix'
          WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' OR host = 'example.net' OR host LIKE '%.example.net' THEN 'aggregator'
          WHEN host = 'example.com' OR regexp_full_match(host, 'blog\.th[a-z]+\.example\.com') THEN 'shared_parent'
          WHEN host = 'cheap-pills.example.com' AND len(segs) = 0 THEN 'tenant_path_required' END AS error,
        CASE WHEN host = 'cheap-pills.example.com' THEN '/' || lower(segs[1]) ELSE '' END AS tenant FROM parts""",
    "parts",
)


@query(
    "c12_official_scope",
    "SELECT page_id, CASE WHEN error IS NULL THEN host END AS domain, CASE WHEN error IS NULL THEN tenant END AS scope_path, error FROM scopes",
    ("scopes",),
)
def c12(t: Tables) -> DataFrame:
    """The trust anchor of every address, or why it has none."""
    scoped = t.pages.withColumn("s", url.official_scope(F.col("url"), PAGE_SCOPES))
    return scoped.select("page_id", "s.domain", "s.scope_path", "s.error")


SUFFIX_LIST = ("com", "example.org", "*.example.net", "!tionsh.example.net")


@query(
    "c12_registrable_hosts",
    """SELECT page_id, len(string_split(host, '.')) > CASE WHEN host = 'tionsh.example.net' OR host LIKE '%.tionsh.example.net' THEN 2
         WHEN host LIKE '%.example.net' THEN 3 WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 2 ELSE 1 END AS registrable FROM parts""",
    ("parts",),
)
def c12_hosts(t: Tables) -> DataFrame:
    """Which hosts have a label in front of their public suffix, with wildcards, exceptions and unlisted ends."""
    rules = t.spark.createDataFrame([(s,) for s in SUFFIX_LIST], "suffix string")
    return url.mark_registrable(t.pages, url.scope_host(F.col("url")), rules, "registrable").select("page_id", "registrable")


@query(
    "c13_scope_matches",
    """SELECT page_id, host = 'example.org' OR host LIKE '%.example.org' AS under_org,
       host = 'cheap-pills.example.com' AND coalesce(lower(segs[1]) = 'en', FALSE) AS under_tenant FROM parts""",
    ("parts",),
)
def c13(t: Tables) -> DataFrame:
    """Addresses under a trusted domain, and under a tenant of a shared host."""
    return t.pages.select(
        "page_id",
        url.scope_matches(F.col("url"), F.lit("Example.org"), F.lit(""), PAGE_SCOPES).alias("under_org"),
        url.scope_matches(F.col("url"), F.lit("cheap-pills.example.com"), F.lit("/en/"), PAGE_SCOPES).alias("under_tenant"),
    )


@query("c14_record_host", "SELECT page_id, host FROM norm", ("norm",))
def c14(t: Tables) -> DataFrame:
    """Candidate host: of the secure link, else of the announcement."""
    apply_url = F.when(F.col("url").startswith("https:"), F.col("url")).otherwise("")
    return t.pages.select("page_id", url.record_host(apply_url, F.col("url")).alias("host"))


@query(
    "c15_title_key",
    r"SELECT page_id, lower(replace(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ', '')) AS title_key FROM titled",
    ("titled",),
)
def c15(t: Tables) -> DataFrame:
    """Titles without blanks and case."""
    return titled(t).select("page_id", text.title_key(F.col("title")).alias("title_key"))


@query(
    "c16_normalize_claim",
    r"""SELECT page_id, 'title' AS field, lower(replace(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ', '')) AS value FROM titled
        UNION ALL SELECT page_id, 'apply_url', norm FROM norm
        UNION ALL SELECT page_id, 'notes', trim(regexp_replace(title, '\s+', ' ', 'g')) FROM titled
        UNION ALL SELECT page_id, 'cities', '["' || array_to_string(list_sort(list_distinct(segs)), '","') || '"]' FROM parts""",
    ("titled", "norm", "parts"),
)
def c16(t: Tables) -> DataFrame:
    """Comparable claim values by field."""
    rows = titled(t)

    def scalar(field: str, column: str) -> DataFrame:
        return rows.select("page_id", F.lit(field).alias("field"), text.normalize_claim(F.lit(field), F.col(column)).alias("value"))

    segments = url.path_segments(url.normalize_url(F.col("url")))
    lists = rows.select("page_id", F.lit("cities").alias("field"), text.normalize_claim_list(segments).alias("value"))
    return scalar("title", "title").unionByName(scalar("apply_url", "url")).unionByName(scalar("notes", "title")).unionByName(lists)


@query(
    "c17_is_missing",
    "SELECT event_id, value < 10 OR (event_type = 'view' AND value < 50) AS missing FROM events",
)
def c17(t: Tables) -> DataFrame:
    """Blank cells and empty JSON values."""
    cell = (
        F.when(F.col("value") < 5, " ").when(F.col("value") < 10, "null")
        .when((F.col("event_type") == "view") & (F.col("value") < 50), "[]").otherwise(F.col("props"))
    )
    return t.events.select("event_id", text.is_missing(cell).alias("missing"))


@query(
    "c18_jaccard",
    """SELECT l_orderkey, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
         ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM (
       SELECT l_orderkey, coalesce(list(DISTINCT l_linestatus || l_returnflag) FILTER (WHERE l_linenumber <= 3), []) AS a,
         coalesce(list(DISTINCT l_linestatus || l_returnflag) FILTER (WHERE l_linenumber > 3), []) AS b FROM lineitem GROUP BY 1)""",
)
def c18(t: Tables) -> DataFrame:
    """How alike the first and the later lines of an order are."""
    flags = F.concat(F.lit(" "), F.lower("l_linestatus"), "l_returnflag")
    sets = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 3, flags)).alias("a"),
        F.collect_set(F.when(F.col("l_linenumber") > 3, flags)).alias("b"),
    )
    return sets.select("l_orderkey", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "c20_contains_term",
    r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS has_the,
        contains(lower(text), 'é é') AS has_phrase FROM documents""",
)
def c20(t: Tables) -> DataFrame:
    """A whole-word term and a plain phrase in the whole texts."""
    return t.documents.select(
        "doc_id",
        text.contains_term(F.col("text"), "the").alias("has_the"),
        text.contains_term(F.col("text"), "É é").alias("has_phrase"),
    )


def _word(term: str) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){term}([^A-Za-z0-9]|$)')"


TAGS_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(_word(w) for w in WORDS[label])} THEN '{label}' END" for label in sorted(WORDS)
)


@query("c21_tag_text", f"SELECT doc_id, concat_ws(',', {TAGS_SQL}) AS tags FROM documents")
def c21(t: Tables) -> DataFrame:
    """Dictionary labels of every text."""
    return t.documents.select("doc_id", F.concat_ws(",", text.tag_text(F.col("text"), WORDS)).alias("tags"))


@query(
    "c22_fold_category",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%HIGH' THEN 'fast' WHEN o_orderpriority LIKE '%LOW' THEN 'slow'
       ELSE lower(o_orderpriority) END AS category FROM orders""",
)
def c22(t: Tables) -> DataFrame:
    """Order priorities folded to categories."""
    folding = (("fast", ("urgent", "high")), ("slow", ("low",)))
    padded = F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))
    return t.orders.select("o_orderkey", text.fold_category(padded, folding).alias("category"))


@query(
    "c23_years_and_ranks",
    """SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1900 AND 2099 AND o_custkey <> year(o_orderdate)
         THEN least(o_custkey, year(o_orderdate)) || ',' || greatest(o_custkey, year(o_orderdate)) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS years,
       CASE WHEN o_orderpriority LIKE '%URGENT' THEN 3 WHEN o_orderpriority LIKE '%HIGH' THEN 2 WHEN o_orderpriority LIKE '%LOW' THEN 1 END AS best FROM orders""",
)
def c23(t: Tables) -> DataFrame:
    """Years inside texts and ranks of names."""
    members = F.array(
        F.concat(F.lit("since "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(F.col("o_custkey").between(1900, 2099), F.concat(F.lit("no "), F.col("o_custkey").cast("string"))).otherwise("none"),
    )
    ranks = text.rank_of(F.array(F.col("o_orderpriority")), (("LOW", 1), ("HIGH", 2), ("URGENT", 3)))
    return t.orders.select(
        "o_orderkey", F.concat_ws(",", text.extract_years(members)).alias("years"), F.array_max(ranks).alias("best")
    )


shared(
    "shown",
    r"""SELECT page_id, clean, CASE
          WHEN broad AND regexp_matches(ctx, 'ou|eau') THEN 'french' WHEN broad AND regexp_matches(ctx, 'sch|ei') THEN 'german'
          WHEN regexp_matches(clean, '(?i)tion') THEN 'nation' WHEN regexp_matches(clean, 'ing[^.]{0,12}er') THEN 'ring'
          WHEN regexp_matches(clean, 're|an') THEN 'state' WHEN regexp_matches(ctx, 'ou|eau') THEN 'french'
          WHEN regexp_matches(ctx, 'sch|ei') THEN 'german' ELSE 'other' END AS shown FROM (
        SELECT page_id, clean, ' ' || clean AS ctx,
          len(regexp_extract_all(clean, 'er|on')) >= 6 OR greatest(len(regexp_extract_all(clean, 'aux')), len(regexp_extract_all(clean, 'th'))) >= 4
          OR len(regexp_extract_all(clean, '[,.;]')) >= 3 OR length(clean) >= 70 AS broad FROM (
          SELECT page_id, regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^[ .*%#]+|[ .*%#]+$', '', 'g') AS clean FROM titled))""",
    "titled",
)


@query("c24_present_title", "SELECT page_id, shown AS title, clean AS source_title FROM shown", ("shown",))
def c24(t: Tables) -> DataFrame:
    """The label shown for a campaign title."""
    judged = titled(t).withColumn(
        "p", classify.present_title(F.col("title"), F.lit("CAMPAIGN"), F.lit(""), PAGE_TITLES)
    )
    return judged.select("page_id", "p.title", "p.source_title")


@query(
    "c25_parse_ts",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 90 MINUTE WHEN 'O' THEN date_trunc('day', o_orderdate) END AS parsed FROM orders""",
)
def c25(t: Tables) -> DataFrame:
    """ISO times, dates followed by text, and free text."""
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:30:00Z"))
    written = (
        F.when(F.col("o_orderstatus") == "F", iso)
        .when(F.col("o_orderstatus") == "O", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 前后")))
        .otherwise("until filled")
    )
    return t.orders.select("o_orderkey", times.parse_ts(written).alias("parsed"))


@query(
    "c26_freshness",
    """SELECT event_id, ts >= TIMESTAMP '2024-01-30 12:00:00' AS fresh, ts < TIMESTAMP '2024-01-30 12:00:00' AS stale FROM events""",
)
def c26(t: Tables) -> DataFrame:
    """Events inside and outside the age limit."""
    return t.events.select(
        "event_id",
        times.is_fresh(F.col("ts"), W.EVENTS_AS_OF, W.EVENTS_MAX_AGE).alias("fresh"),
        times.older_than(F.col("ts"), W.EVENTS_AS_OF, W.EVENTS_MAX_AGE).alias("stale"),
    )


@query(
    "c27_flatten_cell",
    """SELECT event_id, json_extract_string(props, '$.k') AS number_text, CASE WHEN value < 10 THEN '是' ELSE '否' END AS flag_text,
       json_extract_string(props, '$.k') || ' / ' || event_type AS list_text, 'https://e.example/' || event_id AS object_text FROM events""",
)
def c27(t: Tables) -> DataFrame:
    """Numbers, booleans, lists and objects as display text."""
    rows = t.events.withColumns(
        {
            "n": F.variant_get(F.parse_json("props"), "$.k", "variant"),
            "b": F.parse_json(F.to_json(F.struct((F.col("value") < 10).alias("b")))),
            "o": F.parse_json(F.to_json(F.struct(F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")).alias("url"), F.lit("x").alias("text")))),
            "l": F.parse_json(
                F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(',null,"",{"name":"'), "event_type", F.lit('"}]'))
            ),
        }
    )
    return rows.select(
        "event_id",
        flatten_cell(F.col("n")).alias("number_text"),
        flatten_cell(F.variant_get("b", "$.b", "variant")).alias("flag_text"),
        flatten_cell(F.col("l")).alias("list_text"),
        flatten_cell(F.col("o")).alias("object_text"),
    )


LEVELS = 12


@query(
    "c27_deep_cell",
    "SELECT event_id, event_type || ' / 是 / ' || user_id || ' / {\"other\":[' || user_id || ']}' AS shown FROM events",
)
def c27_deep(t: Tables) -> DataFrame:
    """Cells whose texts lie under twelve objects and lists in turn."""
    inner = F.concat(F.lit('[{"name":"'), "event_type", F.lit('"},true,[],{"text":["",{"email":'), F.col("user_id").cast("string"), F.lit('}]},{"other":['), F.col("user_id").cast("string"), F.lit("]}]"))
    cell = inner
    for level in range(LEVELS):
        left, right = ('{"link":null,"text":', "}") if level % 2 else ("[null,", "]")
        cell = F.concat(F.lit(left), cell, F.lit(right))
    return t.events.select("event_id", flatten_cell(F.parse_json(cell)).alias("shown"))


@query("c29_display_list", "SELECT page_id, array_to_string(segs, ' / ') AS shown FROM parts", ("parts",))
def c29(t: Tables) -> DataFrame:
    """Path segments for display."""
    return t.pages.select("page_id", text.display_list(url.path_segments(url.normalize_url(F.col("url")))).alias("shown"))
