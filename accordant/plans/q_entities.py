"""Organizations, matching, lineage, duplicate pairs and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.similarity import indel_ratio
from accordant.functions.text import normalize_company, title_key
from accordant.operators import curation, entities as E, graph, pairs as P
from accordant.plans import workspace as W
from accordant.plans.registry import Tables, query, shared
from accordant.session import stored

SUFFIXES = ("plate", "widget", "ring", "rod")
SUFFIX_SQL = (
    "CASE " + " ".join(
        f"WHEN replace(lower(p_name), ' ', '') LIKE '%{s}' AND length(replace(lower(p_name), ' ', '')) > {len(s)} "
        f"THEN substr(replace(lower(p_name), ' ', ''), 1, length(replace(lower(p_name), ' ', '')) - {len(s)})"
        for s in SUFFIXES
    ) + " ELSE replace(lower(p_name), ' ', '') END"
)
shared(
    "named",
    f"""SELECT p_partkey AS ordinal, p_name AS company, {SUFFIX_SQL} AS normalized_name,
        CASE WHEN p_size < 25 THEN '' ELSE lower(p_type) || '.example.com' END AS host FROM part""",
)
shared(
    "known_orgs",
    """SELECT 'o-' || normalized_name AS org_id, 'known ' || normalized_name AS canonical_name, normalized_name, '' AS candidate_domain,
       CASE WHEN normalized_name < 'n' THEN '' ELSE normalized_name || '.example.com' END AS official_domain
       FROM (SELECT DISTINCT normalized_name FROM named WHERE normalized_name >= 'h')
       UNION ALL SELECT 'x-' || normalized_name, 'second ' || normalized_name, normalized_name, 'kept.example.com', normalized_name || '.example.org'
       FROM (SELECT DISTINCT normalized_name FROM named WHERE normalized_name >= 's')""",
    "named",
)


def named(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("ordinal"),
        F.col("p_name").alias("company"),
        normalize_company(F.col("p_name"), SUFFIXES).alias("normalized_name"),
        F.when(F.col("p_size") < 25, "").otherwise(F.concat(F.lower("p_type"), F.lit(".example.com"))).alias("host"),
    )


def known_orgs(t: Tables) -> DataFrame:
    name = F.col("normalized_name")
    names = named(t).select(name).distinct()
    first = names.filter(name >= "h").select(
        F.concat(F.lit("o-"), name).alias("org_id"), F.concat(F.lit("known "), name).alias("canonical_name"), name,
        F.lit("").alias("candidate_domain"),
        F.when(name < "n", "").otherwise(F.concat(name, F.lit(".example.com"))).alias("official_domain"),
    )
    second = names.filter(name >= "s").select(
        F.concat(F.lit("x-"), name).alias("org_id"), F.concat(F.lit("second "), name).alias("canonical_name"), name,
        F.lit("kept.example.com").alias("candidate_domain"),
        F.concat(name, F.lit(".example.org")).alias("official_domain"),
    )
    return first.unionByName(second)


@query("c4_normalize_company", "SELECT ordinal, normalized_name FROM named", ("named",))
def c4(t: Tables) -> DataFrame:
    """Part names without blanks, case and one listed suffix."""
    return named(t).select("ordinal", "normalized_name")


@query(
    "d1_resolve_orgs",
    """SELECT s.normalized_name, coalesce(t.org_id, substr(sha256('org|' || s.normalized_name), 1, 32)) AS org_id,
       coalesce(t.canonical_name, s.company) AS canonical_name,
       coalesce(nullif(t.candidate_domain, ''), s.host, '') AS candidate_domain, t.org_id IS NULL AS is_new
       FROM (SELECT normalized_name, arg_min(company, ordinal) AS company, arg_min(host, ordinal) FILTER (WHERE host <> '') AS host FROM named GROUP BY 1) s
       LEFT JOIN (SELECT normalized_name, coalesce(min(org_id) FILTER (WHERE official_domain = ''), CASE WHEN count(*) = 1 THEN min(org_id) END) AS pick
                  FROM known_orgs GROUP BY 1) k ON k.normalized_name = s.normalized_name
       LEFT JOIN known_orgs t ON t.org_id = k.pick""",
    ("named", "known_orgs"),
)
def d1(t: Tables) -> DataFrame:
    """The organization behind every part name: open, only, or new."""
    return E.resolve_orgs(named(t), known_orgs(t))


@query("d2_unlinked", "SELECT raw_id FROM raw WHERE kind = 'CAMPAIGN'", ("raw",))
def d2(t: Tables) -> DataFrame:
    """Order lines not linked yet, when the posting rows already are."""
    raw = W.raw(t)
    return E.unlinked(raw, raw.filter("kind = 'POSTING'").select("entity_id", "raw_id")).select("raw_id")


def part_record() -> Column:
    values = {
        "company": F.col("p_brand"),
        "title": F.col("p_name"),
        "apply_url": F.when(F.col("p_size") < 20, "").otherwise(F.concat(F.lit("https://www."), F.lower("p_type"), F.lit(".example.com/jobs//"), "p_size")),
        "announcement_url": F.when(F.col("p_size") < 10, "").otherwise(F.concat(F.lit("https://a.example.com/"), "p_size", F.lit("?utm_source=x"))),
        "official_job_id": F.when(F.col("p_type") == "SMALL", F.concat(F.lit("J-"), "p_size")),
        "source_record_id": F.when(F.col("p_type") != "LARGE", F.col("p_partkey").cast("string")),
    }
    return F.struct(
        *[
            values.get(f, F.array().cast("array<string>") if f in R.LIST_FIELDS else F.lit("")).alias(f)
            for f in R.FIELD_ALIASES
        ]
    )


@query(
    "d3_canonical_key",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'official-job:' || p_brand || ':j-' || p_size
         WHEN p_type <> 'PROMO' AND p_size <= 40 AND p_size >= 20 THEN 'official-url:https://' || lower(p_type) || '.example.com/jobs/' || p_size
         WHEN p_type <> 'PROMO' AND p_size <= 40 AND p_size >= 10 THEN 'official-url:https://a.example.com/' || p_size
         WHEN p_type <> 'LARGE' THEN 'source-record:' || p_type || ':' || p_partkey END AS canonical_key FROM part""",
)
def d3(t: Tables) -> DataFrame:
    """Canonical key of every part record."""
    kind = F.when(F.col("p_type") == "PROMO", "CAMPAIGN").otherwise("POSTING")
    key = E.canonical_key(part_record(), kind, F.col("p_size") > 40, F.col("p_type"), F.col("p_brand"))
    return t.part.select("p_partkey", key.alias("canonical_key"))


def match_rows(t: Tables) -> DataFrame:
    """Parts as raw rows: ids for small and medium ones, links for promos, supplier ids for the rest."""
    kind = F.col("p_type")
    text = F.lit(None).cast("string")
    return t.part.select(
        F.col("p_partkey").alias("raw_id"),
        F.col("p_partkey").alias("ordinal"),
        F.col("p_brand").alias("org_id"),
        F.lit("POSTING").alias("kind"),
        F.col("p_name").alias("title"),
        F.when(kind.isin("SMALL", "MEDIUM"), F.concat(F.lit("J-"), "p_size")).otherwise(text).alias("official_job_id"),
        (kind == "SMALL").alias("has_explicit_id"),
        F.when(kind == "PROMO", F.concat(F.lit("official-url:https://e.example.com/"), "p_size")).otherwise(text).alias("canonical_key"),
        F.lower(kind).alias("source_id"),
        F.when(kind.isin("LARGE", "ECONOMY", "STANDARD"), F.concat_ws("/", "p_brand", "p_size")).otherwise(text).alias("source_record_id"),
        F.when(kind.isin("SMALL", "PROMO"), "OFFICIAL_JOB_ID").otherwise("COMPOUND_HINT").alias("strength"),
        (kind == "ECONOMY").alias("needs_review"),
        F.col("p_retailprice").alias("price"),
    )


shared(
    "match_rows",
    """SELECT p_partkey AS raw_id, p_brand AS org_id, replace(lower(p_name), ' ', '') AS title_key, p_name AS title, p_type, p_size, p_retailprice AS price,
       CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'J-' || p_size END AS job,
       CASE p_type WHEN 'SMALL' THEN 'id|' || p_brand || '|' || p_size
         WHEN 'MEDIUM' THEN 'idt|' || p_brand || '|' || p_size || '|' || replace(lower(p_name), ' ', '')
         WHEN 'PROMO' THEN 'url|' || p_brand || '|' || p_size || '|' || replace(lower(p_name), ' ', '')
         ELSE 'rec|' || lower(p_type) || '|' || p_brand || '|' || p_size END AS key FROM part""",
)
shared(
    "match_known",
    "SELECT raw_id + 1000000000 AS entity_id, * FROM match_rows WHERE price < 950",
    "match_rows",
)
shared(
    "match_index",
    """SELECT key, min(entity_id) AS entity_id FROM (
         SELECT entity_id, 'id|' || org_id || '|' || p_size AS key FROM match_known WHERE job IS NOT NULL
         UNION ALL SELECT entity_id, 'idt|' || org_id || '|' || p_size || '|' || title_key FROM match_known WHERE job IS NOT NULL
         UNION ALL SELECT entity_id, 'url|' || org_id || '|' || p_size || '|' || title_key FROM match_known WHERE p_type = 'PROMO'
         UNION ALL SELECT entity_id, key FROM match_known WHERE key LIKE 'rec|%') GROUP BY 1""",
    "match_known",
)


def match_known(t: Tables) -> DataFrame:
    """Cheap parts are entities already."""
    return match_rows(t).filter("price < 950").withColumns(
        {"entity_id": F.col("raw_id") + 1000000000, "created_at": F.lit("1998-01-01").cast("timestamp")}
    )


def match_index(t: Tables) -> DataFrame:
    known = match_known(t)
    records = known.filter("source_record_id is not null").select("entity_id", "source_id", "source_record_id")
    return E.entity_keys(known, records)


@query(
    "d4_match_entities",
    """SELECT r.raw_id, i.entity_id, CASE WHEN r.key LIKE 'id%' THEN 1 WHEN r.key LIKE 'url%' THEN 2 ELSE 3 END AS rule
       FROM match_rows r JOIN match_index i ON i.key = r.key""",
    ("match_rows", "match_index"),
)
def d4(t: Tables) -> DataFrame:
    """Parts found among known entities, and by which rule."""
    matched, _ = E.match_entities(match_rows(t), match_index(t))
    return matched.select("raw_id", "entity_id", "rule")


shared(
    "unmatched",
    "SELECT r.* FROM match_rows r WHERE NOT EXISTS (SELECT 1 FROM match_index i WHERE i.key = r.key)",
    "match_rows", "match_index",
)
# A derived id finds an explicit one of the same id and title; the explicit ids of one number belong together.
shared(
    "grouped",
    """SELECT u.raw_id, min(u.raw_id) OVER (PARTITION BY CASE WHEN x.raw_id IS NOT NULL THEN 'id|' || u.org_id || '|' || u.p_size ELSE u.key END) AS lead, u.*
       EXCLUDE (raw_id) FROM unmatched u
       LEFT JOIN (SELECT DISTINCT ON (org_id, p_size, title_key) raw_id, org_id, p_size, title_key FROM unmatched WHERE p_type = 'SMALL') x
         ON u.p_type = 'MEDIUM' AND x.org_id = u.org_id AND x.p_size = u.p_size AND x.title_key = u.title_key""",
    "unmatched",
)


@query(
    "d4_group_new",
    "SELECT raw_id, substr(sha256('entity|' || lead), 1, 32) AS entity_id, raw_id = lead AS is_first FROM grouped",
    ("grouped",),
)
def d4_new(t: Tables) -> DataFrame:
    """Parts without a known entity, grouped into new ones by shared keys."""
    _, new = E.match_entities(match_rows(t), match_index(t))
    return new


@query(
    "d5_create_entities",
    """SELECT substr(sha256('entity|' || raw_id), 1, 32) AS entity_id, org_id, title, job AS official_job_id,
       CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'PENDING' ELSE 'REVIEW' END AS review_status FROM grouped WHERE raw_id = lead""",
    ("grouped",),
)
def d5(t: Tables) -> DataFrame:
    """The new entities with their review status."""
    rows = match_rows(t)
    _, new = E.match_entities(rows, match_index(t))
    made = E.create_entities(new, rows, F.lit("2002-01-01").cast("timestamp"))
    return made.select("entity_id", "org_id", "title", "official_job_id", "review_status")


@query("d6_link_origins", "SELECT DISTINCT entity_id, raw_id FROM raw", ("raw",))
def d6(t: Tables) -> DataFrame:
    """Origins after linking every order line, when part of them are linked already."""
    raw = W.raw(t)
    known = raw.filter("kind = 'POSTING'").select("entity_id", "raw_id")
    return E.link_origins(raw.select("entity_id", "raw_id"), known)


def lineage(t: Tables) -> DataFrame:
    return E.lineage(W.entities(t), W.origins(t), W.raw(t), W.batches(t), W.sources(t))


shared(
    "lineage",
    """SELECT r.entity_id, r.raw_id, r.batch_id, r.kind AS raw_kind, e.kind, s.independence_group, s.name AS source_name, b.snapshot_at AS seen_at,
       r.created_at FROM raw r JOIN entities e ON e.entity_id = r.entity_id JOIN batches b ON b.batch_id = r.batch_id
       JOIN sources s ON s.source_id = b.source_id""",
    "raw", "entities", "batches", "sources",
)
shared(
    "lineage_counts",
    """SELECT entity_id, count(*) AS observation_count, count(DISTINCT independence_group) FILTER (WHERE raw_kind = kind) AS source_count,
       max(seen_at) FILTER (WHERE raw_kind = kind) AS latest_seen_at FROM lineage GROUP BY 1""",
    "lineage",
)


@query("d7_lineage", "SELECT entity_id, raw_id, batch_id, raw_kind, source_name, seen_at FROM lineage", ("lineage",))
def d7(t: Tables) -> DataFrame:
    """Every part back to its order lines, batches and suppliers."""
    return lineage(t).select("entity_id", "raw_id", "batch_id", "raw_kind", "source_name", "seen_at")


@query("d7_lineage_counts", "SELECT entity_id, observation_count, source_count, latest_seen_at FROM lineage_counts", ("lineage_counts",))
def d7_counts(t: Tables) -> DataFrame:
    """Observations and independent groups per part."""
    return E.lineage_counts(lineage(t))


def pair_entities(t: Tables) -> DataFrame:
    """Parts as entities of their brand: the size is the city, the type the batch."""
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_brand").alias("org_id"),
        F.lit("POSTING").alias("kind"),
        F.col("p_name").alias("title"),
        F.array(F.col("p_size").cast("string")).alias("cities"),
        F.array().cast("array<string>").alias("graduation_years"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("recruitment_type"),
        F.when(size > 45, F.concat(F.lit("J-"), F.col("p_partkey").cast("string"))).alias("official_job_id"),
        F.lit(None).cast("string").alias("identity_hint"),
        (F.col("p_retailprice") > 950).alias("is_new_weak"),
    )


shared(
    "contents",
    """SELECT p_brand AS org_id, replace(lower(p_name), ' ', '') AS title, p_size, CASE WHEN p_type = 'PROMO' THEN '' ELSE lower(p_type) END AS batch,
       min(p_partkey) AS lead, count(*) AS members, bool_or(p_retailprice > 950) AS has_new,
       min(CASE WHEN p_size > 45 THEN 'J-' || p_partkey END) AS min_id, max(CASE WHEN p_size > 45 THEN 'J-' || p_partkey END) AS max_id,
       count(CASE WHEN p_size > 45 THEN 1 END) AS with_id,
       sha256('{"o":"' || p_brand || '","kind":"POSTING","title_key":"' || replace(lower(p_name), ' ', '') || '","cities":["' || p_size || '"],"years":[],"batch":"'
         || CASE WHEN p_type = 'PROMO' THEN '' ELSE lower(p_type) END || '"}') AS content_id
       FROM part GROUP BY 1, 2, 3, 4""",
)
shared(
    "neighbours",
    """SELECT * FROM (SELECT p_partkey AS left_id, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS right_id, p_size,
       p_retailprice AS price FROM part) WHERE right_id IS NOT NULL""",
)
shared("title_words", "SELECT DISTINCT replace(lower(p_name), ' ', '') AS w FROM part")
# Longest common subsequence by rows; a row is the running maximum of its candidates.
shared(
    "title_ratio",
    """SELECT a, b, 2.0 * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM (
         WITH RECURSIVE dp AS (
           SELECT x.w AS a, y.w AS b, 0 AS i, list_transform(range(0, length(y.w) + 1), lambda z: 0) AS r FROM title_words x, title_words y WHERE x.w < y.w
           UNION ALL
           SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE
             list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], r[k] + CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END))) END)
           FROM dp WHERE i < length(a))
         SELECT * FROM dp WHERE i = length(a))
       UNION ALL SELECT w, w, 1.0 FROM title_words""",
    "title_words",
)


@query(
    "c19_indel_ratio",
    """SELECT n.left_id, n.right_id, round(t.ratio, 6) AS ratio FROM neighbours n
       JOIN part x ON x.p_partkey = n.left_id JOIN part y ON y.p_partkey = n.right_id
       JOIN title_ratio t ON t.a = least(replace(lower(x.p_name), ' ', ''), replace(lower(y.p_name), ' ', ''))
         AND t.b = greatest(replace(lower(x.p_name), ' ', ''), replace(lower(y.p_name), ' ', ''))""",
    ("neighbours", "title_ratio"),
)
def c19(t: Tables) -> DataFrame:
    """Title similarity of every part and the next one of its brand and type."""
    ratio = indel_ratio(title_key(F.col("p_name")), title_key(F.col("r_p_name")))
    return neighbour_pairs(t).select(
        F.col("p_partkey").alias("left_id"), F.col("r_p_partkey").alias("right_id"), F.round(ratio, 6).alias("ratio")
    )


@query(
    "d8_content_groups",
    "SELECT org_id, title AS title_key, batch, lead AS entity_id, members, has_new, with_id FROM contents",
    ("contents",),
)
def d8_groups(t: Tables) -> DataFrame:
    """Distinct contents of every brand with their representative and size."""
    groups = P.content_groups(P.contents(pair_entities(t)))
    return groups.select("org_id", "title_key", "batch", "entity_id", "members", "has_new", "with_id")


shared(
    "stars",
    """SELECT least(p.p_partkey, c.lead) AS left_id, greatest(p.p_partkey, c.lead) AS right_id, 1.0 AS title_similarity, 1.0 AS city_similarity,
       CASE WHEN p.p_size > 45 THEN 0.0 ELSE 0.55 + 0.2 + 0.15 + CASE WHEN c.batch <> '' THEN 0.1 ELSE 0.0 END END AS score,
       CASE WHEN p.p_size > 45 THEN 'SEPARATE' ELSE 'REVIEW' END AS decision
       FROM part p JOIN (SELECT *, CASE WHEN min_id IS NULL THEN lead ELSE CAST(substr(min_id, 3) AS BIGINT) END AS centre FROM contents) c
         ON c.org_id = p.p_brand AND c.title = replace(lower(p.p_name), ' ', '') AND c.p_size = p.p_size AND c.batch = CASE WHEN p.p_type = 'PROMO' THEN '' ELSE lower(p.p_type) END
       WHERE c.has_new AND p.p_partkey <> c.lead AND p.p_size <= 45
       UNION ALL
       SELECT least(p.p_partkey, c.centre), greatest(p.p_partkey, c.centre), 1.0, 1.0, 0.0, 'SEPARATE'
       FROM part p JOIN (SELECT *, CAST(substr(min_id, 3) AS BIGINT) AS centre FROM contents WHERE min_id IS NOT NULL) c
         ON c.org_id = p.p_brand AND c.title = replace(lower(p.p_name), ' ', '') AND c.p_size = p.p_size AND c.batch = CASE WHEN p.p_type = 'PROMO' THEN '' ELSE lower(p.p_type) END
       WHERE c.has_new AND p.p_partkey <> c.centre AND p.p_size > 45""",
    "contents",
)
shared(
    "hubs",
    "SELECT org_id, title, batch, min(content_id) AS hub_content, bool_or(has_new) AS hub_new FROM contents WHERE batch <> '' GROUP BY 1, 2, 3",
    "contents",
)
shared(
    "content_links",
    """SELECT h.hub_content AS a, c.content_id AS b, 1.0 AS t, TRUE AS in_hub FROM contents c JOIN hubs h ON h.org_id = c.org_id AND h.title = c.title AND h.batch = c.batch
         WHERE c.content_id <> h.hub_content AND h.hub_new
       UNION ALL
       SELECT x.hub_content, y.hub_content, r.ratio, TRUE FROM hubs x JOIN hubs y ON x.org_id = y.org_id AND x.batch = y.batch AND x.title < y.title
         JOIN title_ratio r ON r.a = x.title AND r.b = y.title WHERE r.ratio * 0.55 + 0.25 >= 0.78 AND (x.hub_new OR y.hub_new)
       UNION ALL
       SELECT x.content_id, y.content_id, r.ratio, FALSE FROM contents x JOIN contents y
         ON x.org_id = y.org_id AND (x.title < y.title OR (x.title = y.title AND x.content_id < y.content_id))
         JOIN title_ratio r ON r.a = x.title AND r.b = y.title
         WHERE (x.has_new OR y.has_new) AND (x.p_size = y.p_size OR (x.batch = y.batch AND x.batch <> ''))
           AND NOT (x.batch = y.batch AND x.batch <> '' AND r.ratio * 0.55 + 0.25 >= 0.78)""",
    "contents", "hubs", "title_ratio",
)
shared(
    "linked_pairs",
    """SELECT least(x.lead, y.lead) AS left_id, greatest(x.lead, y.lead) AS right_id, l.t AS title_similarity, CASE WHEN x.p_size = y.p_size THEN 1.0 ELSE 0.0 END AS city_similarity,
         l.in_hub, x.batch = y.batch AND x.batch <> '' AS batch_equal,
         x.with_id = x.members AND x.min_id = x.max_id AND y.with_id = y.members AND y.min_id = y.max_id AND x.min_id <> y.min_id AS clash
       FROM content_links l JOIN contents x ON x.content_id = l.a JOIN contents y ON y.content_id = l.b""",
    "content_links", "contents",
)
shared(
    "pairs",
    """SELECT left_id, right_id, title_similarity, city_similarity, score, decision FROM stars
       UNION ALL SELECT left_id, right_id, title_similarity, city_similarity, score, decision FROM (
         SELECT *, coalesce(clash, FALSE) AS c, CASE WHEN coalesce(clash, FALSE) THEN 0.0 ELSE title_similarity * 0.55 + city_similarity * 0.2 + 0.15 + CASE WHEN batch_equal THEN 0.1 ELSE 0.0 END END AS score,
           CASE WHEN coalesce(clash, FALSE) THEN 'SEPARATE' ELSE 'REVIEW' END AS decision FROM linked_pairs)
       WHERE (in_hub AND NOT c) OR (c AND round(title_similarity, 4) >= 0.92 AND city_similarity >= 0.5) OR (NOT c AND score >= 0.78)""",
    "stars", "linked_pairs",
)


@query(
    "d8_candidate_pairs",
    "SELECT left_id, right_id, round(CAST(title_similarity AS DOUBLE), 6) AS title_similarity, CAST(city_similarity AS DOUBLE) AS city_similarity, round(CAST(score AS DOUBLE), 6) AS score, decision FROM pairs",
    ("pairs",),
)
def d8(t: Tables) -> DataFrame:
    """Duplicate candidates of every brand: stars of copies and pairs of close contents."""
    found = P.candidate_pairs(pair_entities(t))
    return found.select(
        "left_id", "right_id", F.round("title_similarity", 6).alias("title_similarity"), "city_similarity",
        F.round("score", 6).alias("score"), "decision",
    )


def found_pairs(t: Tables) -> DataFrame:
    """The duplicate candidates of every brand with their scores to six places."""
    return P.candidate_pairs(pair_entities(t)).withColumn("score", F.round("score", 6))


shared(
    "upserted",
    """SELECT left_id, right_id, CASE WHEN left_id % 6 = 0 THEN 0.1 ELSE round(CAST(score AS DOUBLE), 6) END AS score,
       CASE WHEN left_id % 6 = 0 THEN 'SEPARATE' ELSE decision END AS decision, left_id % 6 = 0 AS reviewed FROM pairs""",
    "pairs",
)


@query("d11_upsert_candidates", "SELECT left_id, right_id, CAST(score AS DOUBLE) AS score, decision, reviewed FROM upserted", ("upserted",))
def d11_candidates(t: Tables) -> DataFrame:
    """New candidates over assessments of an earlier load; what a reviewer has decided since stays."""
    done = upserted_pairs(t)
    return done.select("left_id", "right_id", "score", "decision", F.col("reviewed_at").isNotNull().alias("reviewed"))


def upserted_pairs(t: Tables) -> DataFrame:
    # Read here and as what an earlier load found, so they are worked out once.
    found = stored(found_pairs(t), "found-pairs")
    earlier = found.filter("left_id % 3 = 0").select(
        F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), F.lit(0.1).alias("score"), F.lit("SEPARATE").alias("decision"),
        F.when(F.col("left_id") % 2 == 0, F.lit("2000-01-01").cast("timestamp")).alias("reviewed_at"),
    )
    # Stored pairs are ordered, whichever way round they were met.
    ordered = earlier.withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")})
    return P.upsert_pairs(found, ordered)


shared(
    "reviewed",
    """SELECT left_id, right_id, score, CASE WHEN right_id % 4 = 0 THEN 'MERGE' ELSE decision END AS decision,
       CASE WHEN right_id % 4 = 0 THEN 'same post' END AS reason, reviewed OR right_id % 4 = 0 AS reviewed FROM upserted""",
    "upserted",
)


@query("f10_review_candidates", "SELECT left_id, right_id, CAST(score AS DOUBLE) AS score, decision, reason, reviewed FROM reviewed", ("reviewed",))
def f10_candidates(t: Tables) -> DataFrame:
    """Review commands on the upserted candidates; those without a proper reason change nothing."""
    done = reviewed_pairs(t)
    return done.select("left_id", "right_id", "score", "decision", "reason", F.col("reviewed_at").isNotNull().alias("reviewed"))


def reviewed_pairs(t: Tables) -> DataFrame:
    # Commands, what they may refer to and the pairs themselves read one table.
    pairs = stored(upserted_pairs(t), "upserted-pairs")
    commands = pairs.filter("right_id % 2 = 0").select(
        "left_id", "right_id", F.lit("MERGE").alias("new_decision"),
        F.when(F.col("right_id") % 4 == 0, "same post").otherwise("x").alias("reason"),
        F.lit("2000-02-01").cast("timestamp").alias("at"),
    )
    return P.review_pairs(pairs, commands)[0]


def neighbour_pairs(t: Tables) -> DataFrame:
    """Each part beside the next part of its brand, as explicit pairs to score."""
    following = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    nxt = [F.lead(c).over(following).alias(f"r_{c}") for c in ("p_partkey", "p_name", "p_size", "p_retailprice")]
    return t.part.select("*", *nxt).filter("r_p_partkey is not null")


@query(
    "d9_score_pairs",
    """SELECT l AS left_id, r AS right_id, round(CASE WHEN clash THEN 0.0 WHEN same_hint THEN greatest(w, 0.99) ELSE w END, 6) AS score,
       CASE WHEN clash THEN 'SEPARATE' ELSE 'REVIEW' END AS decision
       FROM (SELECT p.*, t.ratio * 0.55 + CASE WHEN sl = sr THEN 0.2 ELSE 0.0 END + 0.15 + 0.1 AS w, sl > 45 AND sr > 45 AS clash, sl = sr AS same_hint FROM (
         SELECT p_partkey AS l, lead(p_partkey) OVER w AS r, replace(lower(p_name), ' ', '') AS tl, replace(lower(lead(p_name) OVER w), ' ', '') AS tr,
           p_size AS sl, lead(p_size) OVER w AS sr FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)) p
         JOIN title_ratio t ON t.a = least(tl, tr) AND t.b = greatest(tl, tr) WHERE r IS NOT NULL)""",
    ("title_ratio",),
)
def d9(t: Tables) -> DataFrame:
    """Scores of explicitly given pairs."""
    return scored_neighbours(t).select("left_id", "right_id", F.round("score", 6).alias("score"), "decision")


def scored_neighbours(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")

    def job(size: str, key: str) -> Column:
        return F.when(F.col(size) > 45, F.concat(F.lit("J-"), F.col(key).cast("string")))

    pairs = neighbour_pairs(t).select(
        F.col("p_partkey").alias("left_id"),
        F.col("r_p_partkey").alias("right_id"),
        indel_ratio(title_key(F.col("p_name")), title_key(F.col("r_p_name"))).alias("title_similarity"),
        F.array(F.col("p_size").cast("string")).alias("left_cities"),
        F.array(F.col("r_p_size").cast("string")).alias("right_cities"),
        none.alias("left_years"), none.alias("right_years"),
        F.lower("p_type").alias("left_batch"), F.lower("p_type").alias("right_batch"),
        job("p_size", "p_partkey").alias("left_job_id"), job("r_p_size", "r_p_partkey").alias("right_job_id"),
        (F.col("p_size") == F.col("r_p_size")).alias("same_hint"),
    )
    return P.score_pairs(pairs)


@query(
    "d10_prune_pairs",
    """SELECT l AS left_id, r AS right_id FROM (
         SELECT p.*, t.ratio, t.ratio * 0.55 + CASE WHEN sl = sr THEN 0.2 ELSE 0.0 END + 0.25 AS w, sl > 45 AND sr > 45 AS clash FROM (
           SELECT p_partkey AS l, lead(p_partkey) OVER w AS r, replace(lower(p_name), ' ', '') AS tl, replace(lower(lead(p_name) OVER w), ' ', '') AS tr,
             p_size AS sl, lead(p_size) OVER w AS sr FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)) p
         JOIN title_ratio t ON t.a = least(tl, tr) AND t.b = greatest(tl, tr) WHERE r IS NOT NULL)
       WHERE CASE WHEN clash THEN round(ratio, 4) >= 0.92 AND sl = sr ELSE sl = sr OR w >= 0.78 END""",
    ("title_ratio",),
)
def d10(t: Tables) -> DataFrame:
    """Given pairs worth a reviewer's time."""
    return P.prune_pairs(scored_neighbours(t)).select("left_id", "right_id")


@query(
    "d11_upsert_pairs",
    """SELECT left_id, right_id, CAST(CASE WHEN p_size > 25 THEN 0.1 WHEN price > 950 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS score,
       CASE WHEN p_size > 25 THEN 'SEPARATE' WHEN price > 950 THEN 'REVIEW' ELSE 'OLD' END AS decision FROM neighbours""",
    ("neighbours",),
)
def d11(t: Tables) -> DataFrame:
    """New assessments over stored ones; pairs a reviewer has decided stay."""
    near = neighbour_pairs(t).select(
        F.col("p_partkey").alias("left_id"), F.col("r_p_partkey").alias("right_id"), "p_size", F.col("p_retailprice").alias("price")
    )
    reviewed = F.col("p_size") > 25
    known = near.select(
        "left_id", "right_id", F.when(reviewed, 0.1).otherwise(0.5).alias("score"),
        F.when(reviewed, "SEPARATE").otherwise("OLD").alias("decision"),
        F.when(reviewed, F.lit("2000-01-01").cast("timestamp")).alias("reviewed_at"),
    )
    new = near.filter("price > 950").select(
        F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), F.lit(0.9).alias("score"), F.lit("REVIEW").alias("decision")
    )
    return P.upsert_pairs(new, known).select("left_id", "right_id", "score", "decision")


@query(
    "f10_review_pairs",
    """SELECT left_id, right_id, CASE WHEN price > 950 AND p_size > 9 THEN 'MERGE' ELSE 'REVIEW' END AS decision,
       CASE WHEN price > 950 AND p_size > 9 THEN 'size ' || p_size END AS reason FROM neighbours""",
    ("neighbours",),
)
def f10(t: Tables) -> DataFrame:
    """Review commands applied to pairs; those without a proper reason are refused."""
    near = neighbour_pairs(t).select(
        F.col("p_partkey").alias("left_id"), F.col("r_p_partkey").alias("right_id"), "p_size", F.col("p_retailprice").alias("price")
    )
    pairs = near.select("left_id", "right_id", F.lit(0.5).alias("score"), F.lit("REVIEW").alias("decision"))
    commands = near.filter("price > 950").select(
        "left_id", "right_id", F.lit("MERGE").alias("new_decision"),
        F.when(F.col("p_size") > 9, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise("x").alias("reason"),
        F.lit("2000-01-01").cast("timestamp").alias("at"),
    )
    done, _ = P.review_pairs(pairs, commands)
    return done.select("left_id", "right_id", "decision", "reason")


def merge_chain(t: Tables) -> DataFrame:
    """Reviewed merges: every part with the next one of the same brand, name and size, as a chain."""
    following = Window.partitionBy("p_brand", "p_name", "p_size").orderBy("p_partkey")
    return t.part.select(
        F.col("p_partkey").alias("left_id"), F.lead("p_partkey").over(following).alias("right_id")
    ).filter("right_id is not null")


shared(
    "merge_groups",
    """SELECT p_partkey AS entity_id, p_brand, min(p_partkey) OVER g AS root, count(*) OVER g AS members,
       count(DISTINCT CASE WHEN p_retailprice > 970 THEN p_type END) OVER g AS jobs,
       count(DISTINCT CASE WHEN p_type = 'PROMO' THEN 'C' ELSE 'P' END) OVER g AS kinds,
       min(CASE WHEN p_retailprice > 970 THEN p_type END) OVER g AS job_id
       FROM part WINDOW g AS (PARTITION BY p_brand, p_name, p_size)""",
)


def merge_entities(t: Tables) -> DataFrame:
    """Entities whose id, where they have one, is their type, so that some chains conflict."""
    job = t.part.select(
        F.col("p_partkey").alias("entity_id"), F.when(F.col("p_retailprice") > 970, F.col("p_type")).alias("official_job_id")
    )
    return W.entities(t).drop("official_job_id").join(job, "entity_id").select(*W.entities(t).columns)


@query(
    "d12_merge_plan",
    """SELECT entity_id, root, CASE WHEN jobs > 1 THEN 'different_ids' WHEN kinds > 1 THEN 'different_kinds' ELSE 'ok' END AS outcome,
       CASE WHEN jobs = 1 AND kinds = 1 THEN job_id END AS job_id FROM merge_groups WHERE members > 1""",
    ("merge_groups",),
)
def d12_plan(t: Tables) -> DataFrame:
    """Closed chains of reviewed merges, with chains that would mix ids or kinds refused whole."""
    plan, rejected = curation.merge_plan(merge_entities(t), merge_chain(t))
    return plan.select("entity_id", "root", F.lit("ok").alias("outcome"), "job_id").unionByName(
        rejected.select("entity_id", "root", F.col("error").alias("outcome"), F.lit(None).cast("string").alias("job_id"))
    )


@query(
    "d12_connected_components",
    "SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS root FROM part",
)
def d12_components(t: Tables) -> DataFrame:
    """Components over shared brand-and-name keys."""
    key = F.concat_ws("|", "p_brand", "p_name")
    return graph.connect(t.part.select(F.col("p_partkey").alias("node"), key.alias("key")))


@query(
    "d12_contracted_components",
    "SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS root FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_name) > 1",
)
def d12_contracted(t: Tables) -> DataFrame:
    """Components of chains through the parts of one brand and name, by contraction of edges."""
    following = Window.partitionBy("p_brand", "p_name").orderBy(F.xxhash64("p_partkey"))
    chain = t.part.select(F.col("p_partkey").alias("left_id"), F.lead("p_partkey").over(following).alias("right_id"))
    return graph.contract(chain.filter("right_id is not null"))


@query(
    "d13_link_children",
    """SELECT campaign_id, posting_id, CASE WHEN ck IS NULL THEN 'not_found' WHEN pk <> 'CAMPAIGN' THEN 'parent_not_campaign'
       WHEN ck <> 'POSTING' THEN 'child_not_posting' WHEN po <> co THEN 'other_organization' ELSE 'linked' END AS outcome
       FROM (SELECT DISTINCT l_partkey AS campaign_id, l_suppkey AS posting_id FROM lineitem) l
       JOIN (SELECT entity_id, kind AS pk, org_id AS po FROM entities) p ON p.entity_id = l.campaign_id
       LEFT JOIN (SELECT entity_id, kind AS ck, org_id AS co FROM entities) c ON c.entity_id = l.posting_id""",
    ("entities",),
)
def d13(t: Tables) -> DataFrame:
    """Every part and supplier number met in an order line, as a campaign and a posting to link."""
    links = t.lineitem.groupBy(F.col("l_partkey").alias("campaign_id"), F.col("l_suppkey").alias("posting_id")).agg(
        F.lit("line").alias("evidence"), F.lit(1.0).alias("confidence")
    )
    good, bad = E.link_children(links, W.entities(t))
    return good.select("campaign_id", "posting_id", F.lit("linked").alias("outcome")).unionByName(
        bad.select("campaign_id", "posting_id", F.col("error").alias("outcome"))
    )
