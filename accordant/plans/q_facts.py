"""Span-exact facts from the whole documents, their curation, versions and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.text import fact_label
from accordant.operators import facts as T
from accordant.plans.registry import Tables, query, shared
from accordant.session import stored

RULES = R.FactRules(
    graduation=(r"(?U)\bun(?:e|d) ([a-z]{2})", r"(?U)\bthe ([a-z]{2})"),
    graduation_suffix="届",
    education=(("joined", "tion and|ent et"), ("ringed", "(?iu)ING ER")),
    skills=(("the", "(?iu)(?<![A-Za-z0-9])the(?![A-Za-z0-9])"), ("and", "(?iu)(?<![A-Za-z0-9])and(?![A-Za-z0-9])"), ("que", "que")),
    project="la|der",
    experience="of|ment",
    min_story_length=14,
    label_min=2,
    label_max=28,
)

# Lines with offsets: every line's start is the length of all before it.
shared(
    "lines",
    r"""SELECT doc_id, start + length(body) - length(evidence) AS start, start + length(body) AS "end", evidence FROM (
        SELECT doc_id, start, body, regexp_replace(body, '^[ \t#\-*•]*', '') AS evidence FROM (
          SELECT doc_id, regexp_replace(line, '\s+$', '') AS body,
            coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)))
        WHERE evidence <> ''""",
)
shared(
    "labels_of",
    r"""SELECT *, CASE WHEN length(heading) BETWEEN 2 AND 28 THEN heading
          WHEN cleaned <> '' THEN regexp_replace(substr(cleaned, 1, 28), '[，。；; ]+$', '') || CASE WHEN length(cleaned) > 28 THEN '…' ELSE '' END END AS label FROM (
        SELECT *, trim(regexp_replace(cleaned, '[：:](.|\n)*$', '')) AS heading FROM (
          SELECT *, trim(regexp_replace(evidence, '^[#>*•\-\s]+', '')) AS cleaned FROM lines))""",
    "lines",
)
WORD = "regexp_matches(evidence, '(?i)(^|[^A-Za-z0-9]){0}([^A-Za-z0-9]|$)')"
shared(
    "facts",
    rf"""SELECT doc_id, start, "end", evidence, f.kind, f.value FROM labels_of, LATERAL (VALUES
          ('GRADUATION_YEAR', coalesce(nullif(regexp_extract(evidence, '\bun[ed] ([a-z][a-z])', 1), ''), nullif(regexp_extract(evidence, '\bthe ([a-z][a-z])', 1), '')) || '届'),
          ('EDUCATION', CASE WHEN regexp_matches(evidence, 'tion and|ent et') THEN 'joined' END),
          ('EDUCATION', CASE WHEN regexp_matches(evidence, '(?i)ing er') THEN 'ringed' END),
          ('SKILL', CASE WHEN {WORD.format('the')} THEN 'the' END), ('SKILL', CASE WHEN {WORD.format('and')} THEN 'and' END),
          ('SKILL', CASE WHEN evidence LIKE '%que%' THEN 'que' END),
          ('PROJECT', CASE WHEN length(evidence) >= 14 AND regexp_matches(evidence, 'la|der') THEN label END),
          ('EXPERIENCE', CASE WHEN length(evidence) >= 14 AND regexp_matches(evidence, 'of|ment') THEN label END)) AS f(kind, value)
        WHERE f.value IS NOT NULL""",
    "labels_of",
)
shared(
    "facts_with_id",
    """SELECT *, 'fact_' || substr(sha256('d' || doc_id || ':' || start || ':' || "end" || ':' || kind || ':' || value), 1, 16) AS fact_id FROM facts""",
    "facts",
)


def docs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("profile_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text"
    )


def facts(t: Tables) -> DataFrame:
    return T.profile_facts(docs(t), RULES)


def stored_facts(t: Tables) -> DataFrame:
    """The facts, extracted once, for those who read them more than once."""
    return stored(facts(t), "facts")


@query("g1_line_spans", 'SELECT doc_id, start, "end", md5(evidence) AS digest FROM lines', ("lines",))
def g1(t: Tables) -> DataFrame:
    """Every line of every text with its exact span."""
    lines = T.doc_lines(t.documents.select("doc_id", "text"))
    return lines.select("doc_id", "start", "end", F.md5("evidence").alias("digest"))


@query("g2_extract_facts", 'SELECT doc_id, start, "end", kind, value FROM facts', ("facts",))
def g2(t: Tables) -> DataFrame:
    """Facts of every line."""
    lines = T.doc_lines(t.documents.select("doc_id", "text"))
    return T.extract_facts(lines, RULES).select("doc_id", "start", "end", "kind", "value")


@query("g3_fact_label", "SELECT doc_id, start, coalesce(label, 'none') AS label FROM labels_of", ("labels_of",))
def g3(t: Tables) -> DataFrame:
    """A short label for every line."""
    lines = T.doc_lines(t.documents.select("doc_id", "text"))
    return lines.select("doc_id", "start", fact_label(F.col("evidence"), "none", RULES).alias("label"))


@query("g4_fact_ids", "SELECT DISTINCT fact_id, doc_id AS profile_id, kind FROM facts_with_id", ("facts_with_id",))
def g4(t: Tables) -> DataFrame:
    """Facts under their stable ids."""
    return facts(t).select("fact_id", "profile_id", "kind")


@query(
    "g5_extraction_warnings",
    "SELECT doc_id AS profile_id, 'no_facts_extracted' AS warning FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM facts)",
    ("facts",),
)
def g5(t: Tables) -> DataFrame:
    """Texts that yield nothing."""
    return T.extraction_warnings(docs(t), facts(t))


def fact_commands(t: Tables, found: DataFrame) -> DataFrame:
    """Facts of good texts are confirmed; values of toxic ones are corrected."""
    marks = t.labels.select(F.col("doc_id").alias("profile_id"), "quality", "toxic")
    return found.join(marks, "profile_id").select(
        "fact_id",
        F.lit("2024-01-01").cast("timestamp").alias("at"),
        F.when(F.col("quality") == 1, F.lit(True)).alias("new_confirmed"),
        F.when(F.col("toxic") == 1, F.concat("value", F.lit("!"))).alias("new_value"),
    )


shared(
    "curated",
    """SELECT f.fact_id, f.doc_id, f.kind, CASE WHEN l.toxic = 1 THEN f.value || '!' ELSE f.value END AS value,
       CASE WHEN l.toxic = 1 THEN '用户修正：' || f.value || '!' ELSE f.evidence END AS evidence,
       CASE WHEN l.toxic = 1 THEN 0 ELSE f.start END AS start,
       CASE WHEN l.toxic = 1 THEN length('用户修正：' || f.value || '!') ELSE f."end" END AS "end", coalesce(l.quality = 1, FALSE) AS confirmed
       FROM facts_with_id f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
    "facts_with_id",
)


@query(
    "g6_curate_facts",
    'SELECT fact_id, value, md5(evidence) AS digest, start, "end", confirmed FROM curated',
    ("curated",),
)
def g6(t: Tables) -> DataFrame:
    """Facts after confirmations and corrections."""
    found = stored_facts(t)
    curated = T.curate_facts(found, fact_commands(t, found))
    return curated.select("fact_id", "value", F.md5("evidence").alias("digest"), "start", "end", "confirmed")


@query(
    "g7_active_profiles",
    """SELECT owner_id, name, content_hash, created_at, activated_at,
       row_number() OVER (PARTITION BY owner_id ORDER BY activated_at DESC, name DESC, content_hash DESC) = 1 AS is_active FROM (
         SELECT conv_id AS owner_id, role AS name, md5(text) AS content_hash, min(turn) AS created_at, max(turn) AS activated_at FROM conversations GROUP BY 1, 2, 3)""",
)
def g7(t: Tables) -> DataFrame:
    """Conversation turns as uploads: one version per role and text, the last one active."""
    uploads = t.conversations.select(
        F.col("conv_id").alias("owner_id"), F.col("role").alias("name"), F.md5("text").alias("content_hash"), F.col("turn").alias("at")
    )
    return T.active_profiles(uploads)


def preferences(t: Tables) -> DataFrame:
    when = F.lit("2024-01-01").cast("timestamp").alias("at")
    cities = t.documents.select(
        F.col("doc_id").alias("profile_id"), F.lit("accepted_cities").alias("key"),
        F.array(F.col("lang"), F.lit(" "), F.lit("xx")).alias("value"),
        (F.col("n_chars") > 1000).alias("hard_constraint"), F.lit(True).alias("confirmed"), when,
    )
    types = t.documents.select(
        F.col("doc_id").alias("profile_id"), F.lit("accepted_recruitment_types").alias("key"),
        F.array(F.concat(F.col("source"), F.lit("秋招")), F.col("source")).alias("value"),
        F.lit(True).alias("hard_constraint"), (F.col("lang") != "de").alias("confirmed"), when,
    )
    return cities.unionByName(types)


shared(
    "loaded",
    """SELECT d.doc_id AS profile_id, CASE WHEN n_chars > 1000 THEN array_to_string(list_sort([lang, 'xx']), ',') ELSE '' END AS cities,
       CASE WHEN lang <> 'de' THEN source || ',校招' ELSE '' END AS types,
       coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE kind = 'EDUCATION' AND confirmed)), ','), '') AS education,
       coalesce(bool_or(confirmed AND kind IN ('SKILL', 'EXPERIENCE', 'PROJECT')), FALSE) AS has_evidence,
       count(DISTINCT fact_id) FILTER (WHERE confirmed AND kind IN ('SKILL', 'EXPERIENCE', 'PROJECT') AND regexp_matches(value || ' ' || evidence, '(?i)(^|[^A-Za-z0-9])of([^A-Za-z0-9]|$)')) AS of_refs
       FROM documents d LEFT JOIN curated c ON c.doc_id = d.doc_id GROUP BY d.doc_id, n_chars, lang, source""",
    "curated",
)


@query(
    "g8_load_profiles",
    "SELECT profile_id, cities, types, education, has_evidence, of_refs FROM loaded WHERE has_evidence OR education <> '' OR cities <> '' OR types <> '' OR profile_id IN (SELECT doc_id FROM facts_with_id)",
    ("loaded", "facts_with_id"),
)
def g8(t: Tables) -> DataFrame:
    """Profiles as the decision reads them: confirmed facts and hard preferences."""
    rules = R.DecisionRules(dictionary={"of": ("of",)}, type_folding=(("校招", ("秋招",)),))
    found = stored_facts(t)
    curated = T.curate_facts(found, fact_commands(t, found))
    loaded = T.load_profiles(curated, preferences(t), rules)
    return loaded.select(
        "profile_id", F.concat_ws(",", "accepted_cities").alias("cities"), F.concat_ws(",", "accepted_types").alias("types"),
        F.concat_ws(",", "education").alias("education"), "has_evidence",
        F.coalesce(F.size(F.try_element_at("tags", F.lit("of"))), F.lit(0)).alias("of_refs"),
    )


@query(
    "g9_upsert_preferences",
    """SELECT profile_id, key, value, stale FROM (SELECT conv_id AS profile_id, role AS key, md5(text) AS value,
       role = 'user' AS stale, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""",
)
def g9(t: Tables) -> DataFrame:
    """The latest preference per conversation and role; only user turns stand for hard ones."""
    keyed = t.conversations.select(
        F.col("conv_id").alias("profile_id"),
        F.when(F.col("role") == "user", "accepted_cities").otherwise(F.col("role")).alias("key"),
        F.array(F.md5("text")).alias("value"), F.lit(True).alias("hard_constraint"), F.lit(True).alias("confirmed"),
        F.col("turn").alias("at"),
    )
    first = F.col("at") <= 1
    latest, stale = T.upsert_preferences(keyed.filter(first), keyed.filter(~first).unionByName(keyed.filter(first)))
    marked = latest.join(stale.withColumn("_s", F.lit(True)), "profile_id", "left")
    wanted = F.col("key") == "accepted_cities"
    return marked.select(
        "profile_id", F.when(wanted, "user").otherwise(F.col("key")).alias("key"), F.col("value")[0].alias("value"),
        (wanted & F.coalesce("_s", F.lit(False))).alias("stale"),
    )


shared(
    "ranked_evidence",
    """SELECT doc_id, fact_id, start, rank, generic, long, row_number() OVER (PARTITION BY doc_id, start, "end", trim(evidence) ORDER BY rank DESC, generic, long DESC, start, fact_id) AS rn FROM (
         SELECT DISTINCT doc_id, fact_id, start, "end", evidence, CASE kind WHEN 'EXPERIENCE' THEN 3 WHEN 'PROJECT' THEN 2 WHEN 'SKILL' THEN 1 ELSE 0 END AS rank,
           value IN ('the', 'and') AS generic, least(length(evidence), 160) AS long FROM facts_with_id)""",
    "facts_with_id",
)


@query(
    "g10_representative_evidence",
    """SELECT entity_id, fact_id, start FROM (SELECT doc_id AS entity_id, fact_id, start,
       row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, generic, long DESC, start, fact_id) AS top FROM ranked_evidence WHERE rn = 1) WHERE top <= 3""",
    ("ranked_evidence",),
)
def g10(t: Tables) -> DataFrame:
    """The three best excerpts of every text."""
    found = stored_facts(t)
    refs = found.select(F.col("profile_id").alias("entity_id"), "fact_id")
    rules = R.DecisionRules(generic_values=("the", "and"))
    return T.representative_evidence(found, refs, 3, rules).select("entity_id", "fact_id", "start")


@query(
    "g11_erase_profiles",
    """SELECT 'facts' AS table_name, count(DISTINCT fact_id) AS lines FROM facts_with_id WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
       UNION ALL SELECT 'preferences', 2 * count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
       UNION ALL SELECT 'events', count(*) FROM documents
       UNION ALL SELECT 'tombstones', count(*) FROM labels WHERE toxic = 1""",
    ("facts_with_id",),
)
def g11(t: Tables) -> DataFrame:
    """What is left after the profiles of toxic texts are erased."""
    owners = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("profile_id"))
    at = F.lit("2024-02-01").cast("timestamp")
    events = t.documents.select(
        F.lit("profile").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"),
        F.lit("PROFILE_EXTRACTED").alias("event_type"), at.alias("created_at"), F.lit("{}").alias("payload"),
    )
    state = {"facts": facts(t), "preferences": preferences(t), "events": events}
    left = T.erase_profiles(state, owners, at)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("lines")).select(F.lit(name).alias("table_name"), "lines")

    return (
        count(left["facts"], "facts")
        .unionByName(count(left["preferences"], "preferences"))
        .unionByName(count(left["events"], "events"))
        .unionByName(count(left["events"].filter("event_type = 'PROFILE_DELETED'"), "tombstones"))
    )
