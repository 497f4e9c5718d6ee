"""Official checks and curation commands over the working tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import curation, verification as V
from accordant.plans import workspace as W
from accordant.plans.q_claims import mixed_claims
from accordant.plans.registry import Tables, query, shared

SCOPES = dataclasses.replace(R.ScopeRules(), public_suffixes=("com", "net", "org", "example.com"))


def given_attempts(t: Tables) -> DataFrame:
    """Checks as a reviewer sends them: weak ones with a short excerpt, some with fields."""
    k = F.get_json_object("props", "$.k").cast("int")
    sent = t.events.select(
        F.col("event_id").cast("string").alias("verification_id"),
        F.when(k < 50, "ok").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" page "))).alias("excerpt"),
        F.when(F.col("value") < 20, F.expr("map('cities', array(' A ', '', 'B'))"))
        .otherwise(F.expr("cast(map() as map<string, array<string>>)"))
        .alias("fields"),
    )
    return W.attempts(t).drop("scope", "domain", "scope_path", "created_at").join(sent, "verification_id")


shared(
    "judged",
    """SELECT a.verification_id, a.entity_id, a.result, a.checked_at, x.k, x.value, e.kind, o.official_domain, x.event_type,
       CASE WHEN e.entity_id IS NULL THEN 'not_found' WHEN NOT o.domain_verified THEN 'domain_unknown'
         WHEN a.domain <> o.official_domain THEN 'outside_scope'
         WHEN a.result IN ('OPEN', 'CLOSED') AND x.k < 50 THEN 'excerpt_too_short'
         WHEN a.result IN ('OPEN', 'CLOSED') AND e.kind = 'POSTING' AND e.official_job_id IS NULL THEN 'posting_id_missing'
         WHEN a.result IN ('OPEN', 'CLOSED') AND e.kind = 'POSTING' AND e.official_job_id <> a.url_job THEN 'url_does_not_match_id' END AS error
       FROM attempts a JOIN (SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type FROM events) x ON x.id = a.verification_id
       LEFT JOIN entities e ON e.entity_id = a.entity_id LEFT JOIN orgs o ON o.org_id = e.org_id""",
    "attempts", "entities", "orgs",
)


@query("f1_validate_evidence", "SELECT verification_id, coalesce(error, 'ok') AS outcome FROM judged", ("judged",))
def f1(t: Tables) -> DataFrame:
    """Every check accepted or refused with the first rule it breaks."""
    ok, bad = V.validate_evidence(given_attempts(t), W.entities(t), W.orgs(t), SCOPES)
    return ok.select("verification_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("verification_id", F.col("error").alias("outcome"))
    )


shared(
    "recorded",
    """SELECT *, CASE WHEN result NOT IN ('OPEN', 'CLOSED') AND value < 20 THEN 'fields_need_conclusive_result'
       WHEN checked_at > TIMESTAMP '2024-01-20 00:05:00' THEN 'checked_in_future' ELSE 'recorded' END AS outcome FROM judged WHERE error IS NULL""",
    "judged",
)


@query(
    "f2_record_attempts",
    """SELECT verification_id, outcome, CASE WHEN outcome = 'recorded' THEN kind END AS scope,
       CASE WHEN outcome = 'recorded' THEN official_domain END AS domain,
       CASE WHEN outcome = 'recorded' AND result IN ('OPEN', 'CLOSED') THEN result END AS status,
       CASE WHEN outcome = 'recorded' THEN sha256(CASE WHEN k < 50 THEN 'ok' ELSE event_type || ' page' END) END AS content_hash,
       CASE WHEN outcome = 'recorded' AND value < 20 THEN 'A,B' END AS cities FROM recorded""",
    ("recorded",),
)
def f2(t: Tables) -> DataFrame:
    """Accepted checks as stored, bound to kind and domain, or refused at recording."""
    ok, _ = V.validate_evidence(given_attempts(t), W.entities(t), W.orgs(t), SCOPES)
    lines, bad = V.record_attempts(ok, "2024-01-20 00:00:00")
    text = F.lit(None).cast("string")
    stored = lines.select(
        "verification_id", F.lit("recorded").alias("outcome"), "scope", "domain",
        F.try_element_at("fields", F.lit("status"))[0].alias("status"), "content_hash",
        F.array_join(F.try_element_at("fields", F.lit("cities")), ",").alias("cities"),
    )
    refused = bad.select(
        "verification_id", F.col("error").alias("outcome"),
        *[text.alias(c) for c in ("scope", "domain", "status", "content_hash", "cities")],
    )
    return stored.unionByName(refused)


@query(
    "f3_sanitize_fields",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'unsupported_fields:title' WHEN 'click' THEN 'not_text:deadline' ELSE 'ok' END AS outcome,
       CASE event_type WHEN 'error' THEN 'cities=x,' || substr(repeat(CAST(event_id AS VARCHAR), 100), 1, 100) WHEN 'signup' THEN 'deadline=2024-01-01' WHEN 'purchase' THEN '' END AS fields FROM events""",
)
def f3(t: Tables) -> DataFrame:
    """Fields of checks trimmed to their limits, or refused."""
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    sent = t.events.select(
        F.col("event_id").alias("verification_id"),
        F.col("user_id").alias("entity_id"),
        F.when(kind == "view", F.create_map(F.lit("title"), F.array(F.lit("t"))))
        .when(kind == "click", F.create_map(F.lit("deadline"), F.array(F.lit("a"), F.lit("b"))))
        .when(kind == "error", F.create_map(F.lit("cities"), F.array(F.lit(" x "), F.lit(" "), F.repeat(number, F.lit(100)))))
        .when(kind == "signup", F.create_map(F.lit("deadline"), F.array(F.lit(" 2024-01-01 "))))
        .alias("fields"),
    )
    ok, bad = V.sanitize_fields(sent)
    shown = F.transform(
        F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))
    )
    return ok.select(F.col("verification_id").alias("event_id"), F.lit("ok").alias("outcome"), F.array_join(shown, ";").alias("fields")).unionByName(
        bad.select(F.col("verification_id").alias("event_id"), F.col("error").alias("outcome"), F.lit(None).cast("string").alias("fields"))
    )


@query(
    "f4_attempt_claims",
    """SELECT verification_id || ':status' AS claim_id, entity_id, 'status' AS field, result AS value_key, CASE WHEN scope = 'CAMPAIGN' THEN 20 ELSE 30 END AS authority,
         'verification:' || scope || ':' || domain AS source_key FROM attempts
       UNION ALL SELECT verification_id || ':cities', entity_id, 'cities', '["' || result || '","x"]', CASE WHEN scope = 'CAMPAIGN' THEN 20 ELSE 30 END,
         'verification:' || scope || ':' || domain FROM attempts""",
    ("attempts",),
)
def f4(t: Tables) -> DataFrame:
    """Claims of recorded checks."""
    fields = F.create_map(
        F.lit("status"), F.array("result"), F.lit("cities"), F.array(F.col("result"), F.lit("x")), F.lit("deadline"), F.array(F.lit(""))
    )
    claims = V.attempt_claims(W.attempts(t).withColumn("fields", fields))
    return claims.select("claim_id", "entity_id", "field", "value_key", "authority", "source_key")


@query("f5_effective_attempt", "SELECT entity_id, verification_id, result, checked_at FROM effective", ("effective",))
def f5(t: Tables) -> DataFrame:
    """The check that speaks for each part."""
    return V.effective_attempt(W.attempts(t), W.entities(t), W.orgs(t))


@query(
    "f6_validate_identity_url",
    """SELECT a.verification_id, CASE WHEN e.entity_id IS NULL THEN 'not_found' WHEN NOT o.domain_verified THEN 'domain_unknown'
         WHEN a.domain <> o.official_domain THEN 'outside_scope' WHEN a.url_job <> 'P-' || a.entity_id THEN 'url_does_not_match_id' ELSE 'ok' END AS outcome
       FROM attempts a LEFT JOIN entities e ON e.entity_id = a.entity_id LEFT JOIN orgs o ON o.org_id = e.org_id""",
    ("attempts", "entities", "orgs"),
)
def f6(t: Tables) -> DataFrame:
    """Whether the address of a check could bind the part's id."""
    commands = W.attempts(t).select(
        "verification_id", "entity_id", "url", F.concat(F.lit("P-"), F.col("entity_id").cast("string")).alias("official_job_id")
    )
    judged = V.validate_identity_url(commands, W.entities(t), W.orgs(t), SCOPES)
    return judged.select("verification_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


def working_state(t: Tables) -> dict[str, DataFrame]:
    claims = mixed_claims(t).withColumns({"selected": F.lit(False), "reason": F.lit("")})
    links = t.lineitem.select(F.col("l_partkey").alias("campaign_id"), F.col("l_suppkey").alias("posting_id")).distinct()
    return {
        "orgs": W.orgs(t), "entities": W.entities(t), "origins": W.origins(t), "raw": W.raw(t), "claims": claims,
        "attempts": W.attempts(t), "decisions": W.decisions(t), "links": links, "shortlist": W.shortlist(t),
    }


def domain_commands(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter("event_type = 'click'").select(
        F.col("user_id").alias("entity_id"),
        F.when(k < 50, F.concat(F.lit("https://www.jobs"), k.cast("string"), F.lit(".brand.example.com/x")))
        .when(k < 80, "example.com")
        .otherwise("127.0.0.1")
        .alias("domain_text"),
        F.col("ts").alias("at"),
    )


shared(
    "anchored",
    """SELECT e.org_id, arg_max(k, struct_pack(a := ts, d := 'jobs' || k || '.brand.example.com')) AS k FROM
       (SELECT user_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click') c
       JOIN entities e ON e.entity_id = c.user_id WHERE k < 50 GROUP BY 1""",
    "entities",
)


@query(
    "f7_confirm_domains",
    """SELECT o.org_id, CASE WHEN a.org_id IS NULL THEN o.official_domain ELSE 'jobs' || a.k || '.brand.example.com' END AS official_domain,
       o.domain_verified OR a.org_id IS NOT NULL AS domain_verified FROM orgs o LEFT JOIN anchored a ON a.org_id = o.org_id""",
    ("orgs", "anchored"),
)
def f7(t: Tables) -> DataFrame:
    """Brands after the domain commands of their parts."""
    moved, _ = curation.confirm_domains(working_state(t), domain_commands(t), SCOPES)
    return moved["orgs"].select("org_id", "official_domain", "domain_verified")


@query(
    "f7_decisions_after_domains",
    """SELECT d.decision_id, d.is_current AND a.org_id IS NULL AS is_current FROM decisions d LEFT JOIN entities e ON e.entity_id = d.entity_id
       LEFT JOIN anchored a ON a.org_id = e.org_id""",
    ("decisions", "entities", "anchored"),
)
def f7_decisions(t: Tables) -> DataFrame:
    """Decisions of all parts of an anchored brand are stale."""
    moved, _ = curation.confirm_domains(working_state(t), domain_commands(t), SCOPES)
    return moved["decisions"].select("decision_id", "is_current")


@query(
    "f8_confirm_identities",
    """SELECT e.entity_id, CASE WHEN c.entity_id IS NOT NULL THEN 'p-' || e.entity_id ELSE e.official_job_id END AS official_job_id,
       CASE WHEN c.entity_id IS NOT NULL THEN 'official-job:' || lower(e.org_id) || ':p-' || e.entity_id END AS canonical_key
       FROM entities e LEFT JOIN (SELECT DISTINCT a.entity_id FROM attempts a JOIN entities e ON e.entity_id = a.entity_id JOIN orgs o ON o.org_id = e.org_id
         WHERE e.kind = 'POSTING' AND o.domain_verified AND a.domain = o.official_domain AND a.url_job = 'P-' || a.entity_id) c ON c.entity_id = e.entity_id""",
    ("entities", "attempts", "orgs"),
)
def f8(t: Tables) -> DataFrame:
    """Parts after commands to bind their id, one command per check."""
    commands = W.attempts(t).select(
        "entity_id", F.concat(F.lit(" P-"), F.col("entity_id").cast("string")).alias("official_job_id"), "url",
        F.col("checked_at").alias("at"),
    )
    moved, _ = curation.confirm_identities(working_state(t), commands, SCOPES)
    return moved["entities"].select("entity_id", "official_job_id", "canonical_key")


shared(
    "moves",
    """SELECT user_id AS entity_id, arg_max(CASE WHEN value < 35 THEN 'CAMPAIGN' ELSE 'POSTING' END, struct_pack(a := ts, k := CASE WHEN value < 35 THEN 'CAMPAIGN' ELSE 'POSTING' END)) AS new_kind
       FROM events WHERE event_type = 'error' GROUP BY 1""",
)


def kind_commands(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").select(
        F.col("user_id").alias("entity_id"), F.when(F.col("value") < 35, "CAMPAIGN").otherwise("POSTING").alias("new_kind"),
        F.col("ts").alias("at"),
    )


@query(
    "f9_reclassify",
    """SELECT e.entity_id, coalesce(m.new_kind, e.kind) AS kind, CASE WHEN m.new_kind <> e.kind THEN 'USER_CONFIRMED' ELSE e.review_status END AS review_status,
       CASE WHEN m.new_kind = 'CAMPAIGN' AND e.kind = 'POSTING' THEN NULL ELSE e.official_job_id END AS official_job_id
       FROM entities e LEFT JOIN moves m ON m.entity_id = e.entity_id""",
    ("entities", "moves"),
)
def f9(t: Tables) -> DataFrame:
    """Parts after reclassification commands."""
    moved, _ = curation.reclassify(working_state(t), kind_commands(t))
    return moved["entities"].select("entity_id", "kind", "review_status", "official_job_id")


@query(
    "f9_attempts_after_reclassify",
    """SELECT a.verification_id, CASE WHEN m.new_kind <> e.kind AND a.scope = e.kind THEN 'UNKNOWN' ELSE a.scope END AS scope
       FROM attempts a LEFT JOIN entities e ON e.entity_id = a.entity_id LEFT JOIN moves m ON m.entity_id = a.entity_id""",
    ("attempts", "entities", "moves"),
)
def f9_attempts(t: Tables) -> DataFrame:
    """Checks made for the former kind lose their scope."""
    moved, _ = curation.reclassify(working_state(t), kind_commands(t))
    return moved["attempts"].select("verification_id", "scope")


@query(
    "d12_apply_merges_shortlist",
    """SELECT root AS entity_id, max(priority) AS priority, string_agg(CASE WHEN rn = 1 THEN note END, '；' ORDER BY later, added_at, note) AS note FROM (
         SELECT coalesce(g.root, s.entity_id) AS root, s.priority, s.note, s.added_at, coalesce(g.root <> s.entity_id, FALSE) AS later,
           row_number() OVER (PARTITION BY coalesce(g.root, s.entity_id), s.note ORDER BY coalesce(g.root <> s.entity_id, FALSE), s.added_at) AS rn
         FROM shortlist s LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type) AS root FROM part) g ON g.p_partkey = s.entity_id)
       GROUP BY root""",
    ("shortlist",),
)
def d12_shortlist(t: Tables) -> DataFrame:
    """The shortlist after merging all parts of one brand, name and type: highest priority, notes joined."""
    moved, _ = merged_state(t)
    return moved["shortlist"].select("entity_id", "priority", "note")


def merged_state(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    lead = t.part.groupBy("p_brand", "p_name", "p_type").agg(F.min("p_partkey").alias("left_id"))
    merges = t.part.join(lead, ["p_brand", "p_name", "p_type"]).filter("p_partkey <> left_id").select(
        "left_id", F.col("p_partkey").alias("right_id")
    )
    state = working_state(t)
    state["entities"] = state["entities"].withColumn("official_job_id", F.lit(None).cast("string"))
    return curation.apply_merges(state, merges)


@query(
    "d12_apply_merges",
    """SELECT p_partkey AS entity_id, CASE WHEN p_partkey <> min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type) THEN 'MERGED'
         WHEN p_size = 50 THEN 'MERGED' WHEN p_size < 10 THEN 'REVIEW' ELSE 'PENDING' END AS review_status FROM part""",
)
def d12(t: Tables) -> DataFrame:
    """Entities after the merges; shells stay, marked."""
    moved, _ = merged_state(t)
    return moved["entities"].select("entity_id", "review_status")


@query(
    "d12_apply_merges_origins",
    """SELECT g.root AS entity_id, count(*) AS origins FROM (SELECT DISTINCT entity_id, raw_id FROM raw) r
       JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type) AS root FROM part) g ON g.p_partkey = r.entity_id GROUP BY 1""",
    ("raw",),
)
def d12_origins(t: Tables) -> DataFrame:
    """Origins per entity after the merges."""
    moved, _ = merged_state(t)
    return moved["origins"].groupBy("entity_id").agg(F.count("*").alias("origins"))
