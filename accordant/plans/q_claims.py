"""Claims: unpivot, scope, resolution, decision and display values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.operators import claims as C, state as ST
from accordant.plans import workspace as W
from accordant.plans.registry import Tables, query, shared
from accordant.plans.stored import loaded_twice
from accordant.plans.workspace import resolution_sql

CLAIM = ["entity_id", "field", "claim_id"]


@query("e1_unpivot_claims", "SELECT entity_id, field, claim_id, value_key, authority, source_key, observed_at FROM claims", ("claims",))
def e1(t: Tables) -> DataFrame:
    """Every order line as one claim per field."""
    return W.line_claims(t).select(*CLAIM, "value_key", "authority", "source_key", "observed_at")


@query(
    "e2_authority",
    """SELECT r.raw_id, CASE WHEN s.kind = 'OFFICIAL' AND o.domain_verified
              THEN CASE WHEN r.kind = 'POSTING' THEN 30 ELSE 20 END ELSE 10 END AS authority
       FROM raw r JOIN sources s ON s.source_id = r.source_id JOIN entities e ON e.entity_id = r.entity_id
       JOIN orgs o ON o.org_id = e.org_id""",
    ("raw", "sources", "entities", "orgs"),
)
def e2(t: Tables) -> DataFrame:
    """Authority of every raw row by its kind, source kind and the trust in the domain."""
    raw, sources = W.raw(t), W.sources(t).select("source_id", F.col("kind").alias("source_kind"))
    anchors = W.entities(t).join(W.orgs(t), "org_id").select("entity_id", "domain_verified")
    joined = raw.join(sources, "source_id").join(anchors, "entity_id")
    return joined.select("raw_id", C.authority(F.col("kind"), F.col("source_kind"), F.col("domain_verified")).alias("authority"))


@query(
    "e3_source_key",
    """SELECT raw_id AS evidence_id, 'raw:' || s.independence_group AS source_key FROM raw r JOIN sources s ON s.source_id = r.source_id
       UNION ALL SELECT verification_id, 'verification:' || scope || ':' || domain FROM attempts
       UNION ALL SELECT CAST(event_id AS VARCHAR), 'manual:' || event_type FROM events WHERE event_type = 'view'""",
    ("raw", "sources", "attempts"),
)
def e3(t: Tables) -> DataFrame:
    """Whose voice each piece of evidence is."""
    text = F.lit(None).cast("string")
    rows = W.raw(t).join(W.sources(t).select("source_id", "independence_group"), "source_id").select(
        F.col("raw_id").alias("evidence_id"), text.alias("scope"), text.alias("domain"), "independence_group", text.alias("parser")
    )
    checks = W.attempts(t).select(
        F.col("verification_id").alias("evidence_id"), "scope", "domain", text.alias("independence_group"), text.alias("parser")
    )
    manual = t.events.filter("event_type = 'view'").select(
        F.col("event_id").cast("string").alias("evidence_id"), text.alias("scope"), text.alias("domain"),
        text.alias("independence_group"), F.col("event_type").alias("parser"),
    )
    every = rows.unionByName(checks).unionByName(manual)
    return every.select(
        "evidence_id",
        C.source_key(F.col("scope"), F.col("domain"), F.col("independence_group"), F.col("parser")).alias("source_key"),
    )


@query(
    "e4_latest_per_source",
    "SELECT entity_id, field, source_key, claim_id, value_key, authority FROM latest",
    ("latest",),
)
def e4(t: Tables) -> DataFrame:
    """The newest populated claim of every source."""
    latest = C.latest_per_source(W.line_rows(t)).filter("latest is not null")
    return latest.select(*C.SOURCE_GROUP, "latest.claim_id", "latest.value_key", "latest.authority")


@query(
    "e5_resolve_claims",
    "SELECT entity_id, field, claim_id, reason, reason = 'selected' AS selected FROM labelled",
    ("labelled",),
)
def e5(t: Tables) -> DataFrame:
    """Every claim with its label after resolution by authority and recency."""
    return C.resolve_claims(W.line_rows(t)).select(*CLAIM, "reason", "selected")


@query(
    "e5_verdicts",
    """SELECT entity_id, field, CASE WHEN top_values > 1 THEN 'conflict' ELSE 'selected' END AS state, top_authority,
       CASE WHEN top_values = 1 THEN newest_id END AS selected_id, CASE WHEN top_values = 1 THEN newest_key END AS selected_key,
       sources FROM verdict
       UNION ALL SELECT DISTINCT c.entity_id, c.field, 'missing', NULL, NULL, NULL, 0 FROM claims c
       WHERE NOT EXISTS (SELECT 1 FROM verdict v WHERE v.entity_id = c.entity_id AND v.field = c.field)""",
    ("verdict", "claims"),
)
def e5_verdicts(t: Tables) -> DataFrame:
    """One verdict per entity and field, without labelling the claims."""
    return C.verdicts(W.line_rows(t)).select(*C.GROUP, "state", "top_authority", "selected_id", "selected_key", "sources")


@query(
    "e5_label_counts",
    "SELECT field, reason, count(*) AS claims, count(DISTINCT entity_id) AS entities FROM labelled GROUP BY ALL",
    ("labelled",),
)
def flagship(t: Tables) -> DataFrame:
    """Claims and entities per field and label: unpivot, latest per source, resolution, report."""
    resolved = C.resolve_claims(W.line_rows(t))
    per_entity = resolved.groupBy("field", "reason", "entity_id").agg(F.count("*").alias("n"))
    return per_entity.groupBy("field", "reason").agg(
        F.sum("n").alias("claims"), F.count("*").alias("entities")
    )


@query(
    "e6_label_missing",
    """SELECT entity_id, field, count(*) AS claims, 'all_missing' AS reason FROM order_claims GROUP BY 1, 2
       HAVING count(*) FILTER (WHERE value_key <> '') = 0""",
    ("order_claims",),
)
def e6(t: Tables) -> DataFrame:
    """Fields of an order that no line says anything about."""
    return C.label_missing(W.line_claims(t, "l_orderkey"))


@query(
    "e7_refresh_claims",
    """SELECT l.field, o.domain_verified AS refreshed, CASE WHEN o.domain_verified THEN l.reason ELSE '' END AS reason, count(*) AS claims
       FROM labelled l JOIN entities e ON e.entity_id = l.entity_id JOIN orgs o ON o.org_id = e.org_id GROUP BY ALL""",
    ("labelled", "entities", "orgs"),
)
def e7(t: Tables) -> DataFrame:
    """Claims of the parts of trusted brands resolved again, the others untouched."""
    claims = W.line_claims(t).withColumns({"selected": F.lit(False), "reason": F.lit("")})
    anchored = W.entities(t).join(W.orgs(t), "org_id").select("entity_id", "domain_verified")
    refreshed = C.refresh_claims(claims, anchored.filter("domain_verified"))
    return (
        refreshed.join(anchored, "entity_id")
        .groupBy("field", F.col("domain_verified").alias("refreshed"), "reason")
        .agg(F.count("*").alias("claims"))
    )


shared("kept_claims", "SELECT * FROM claims WHERE source_key <> 'raw:7'", "claims")
resolution_sql("kept_claims", "kept_")


@query(
    "e7_incremental_state",
    """SELECT g.entity_id, g.field, CASE WHEN v.entity_id IS NULL THEN 'missing' WHEN v.top_values > 1 THEN 'conflict' ELSE 'selected' END AS state,
         CASE WHEN v.top_values = 1 THEN v.newest_id END AS selected_id, CASE WHEN v.top_values = 1 THEN v.newest_key END AS selected_key,
         v.top_authority, coalesce(v.sources, 0) AS sources, coalesce(g.least <> g.most, FALSE) AS differs
       FROM (SELECT entity_id, field, min(CASE WHEN value_key <> '' THEN value_key END) AS least, max(CASE WHEN value_key <> '' THEN value_key END) AS most
             FROM kept_claims GROUP BY 1, 2) g LEFT JOIN kept_verdict v ON v.entity_id = g.entity_id AND v.field = g.field""",
    ("kept_claims", "kept_verdict"),
)
def e7_state(t: Tables) -> DataFrame:
    """Facts of every group after two loads and a retirement, each of which touched its own groups only."""
    facts = ST.current_facts(loaded_twice(t))
    return facts.select(*C.GROUP, "state", "selected_id", "selected_key", "top_authority", "sources", "differs")


@query(
    "e8_fresh_values",
    f"""SELECT entity_id, field,
         coalesce(max(CASE WHEN reason = 'selected' THEN value_key END),
           CASE WHEN count(DISTINCT value_key) FILTER (WHERE authority = top) = 1
                THEN max(value_key) FILTER (WHERE authority = top) END) AS value_key,
         bool_or(reason = 'conflict') AS in_conflict
       FROM (SELECT *, max(authority) OVER (PARTITION BY entity_id, field) AS top FROM labelled
             WHERE value_key <> '' AND observed_at >= TIMESTAMP '{W.LINES_AS_OF}' - to_days({int(W.LINES_MAX_AGE)}))
       GROUP BY 1, 2""",
    ("labelled",),
)
def e8(t: Tables) -> DataFrame:
    """Decision values from fresh claims only."""
    values = C.fresh_values(C.resolve_claims(W.line_rows(t)), W.LINES_AS_OF, W.LINES_MAX_AGE)
    return values.select(*C.GROUP, "value_key", "in_conflict")


@query(
    "e8_pivoted_values",
    f"""SELECT entity_id, {", ".join(f"coalesce(max(CASE WHEN field = '{f}' AND reason = 'selected' THEN value_key END), '') AS {f}"
        for f in ("returnflag", "linestatus", "discounted"))} FROM labelled GROUP BY entity_id""",
    ("labelled",),
)
def e8_pivot(t: Tables) -> DataFrame:
    """Selected values side by side, one line per part."""
    verdicts = C.verdicts(W.line_rows(t))
    return C.pivot_values(verdicts, ("returnflag", "linestatus", "discounted"), "selected_key")


shared(
    "display",
    """SELECT entity_id, field, max(CASE WHEN reason = 'selected' THEN value_key END) AS chosen,
         arg_max(value_key, struct_pack(a := authority, o := observed_at, c := created_at, i := claim_id)) FILTER (WHERE value_key <> '') AS best,
         count(DISTINCT value_key) FILTER (WHERE value_key <> '') > 1 AS differs,
         count(DISTINCT value_key) FILTER (WHERE value_key <> '' AND authority = top) > 1 AS torn
       FROM (SELECT *, max(CASE WHEN value_key <> '' THEN authority END) OVER (PARTITION BY entity_id, field) AS top FROM labelled)
       GROUP BY 1, 2""",
    "labelled",
)


@query(
    "e9_display_values",
    """SELECT entity_id, field, chosen IS NULL AND torn AS conflict, differs,
       CASE WHEN NOT (chosen IS NULL AND torn) THEN coalesce(chosen, best) END AS value FROM display""",
    ("display",),
)
def e9(t: Tables) -> DataFrame:
    """Shown values with conflict and difference flags."""
    return C.display_values(C.resolve_claims(W.line_rows(t)))


@query(
    "e9_display_counts",
    """SELECT entity_id, count(*) FILTER (WHERE chosen IS NULL AND torn) AS conflict_count,
       count(*) FILTER (WHERE differs) AS historical_difference_count FROM display GROUP BY 1""",
    ("display",),
)
def e9_counts(t: Tables) -> DataFrame:
    """Conflicting and differing fields per part."""
    return C.display_counts(C.display_values(C.resolve_claims(W.line_rows(t))))


@query(
    "e10_best_value",
    """SELECT entity_id, field, arg_max(value_key, struct_pack(s := reason = 'selected', o := observed_at, i := claim_id)) AS value_key
       FROM labelled WHERE field IN ('returnflag', 'discounted') GROUP BY 1, 2""",
    ("labelled",),
)
def e10(t: Tables) -> DataFrame:
    """The selected claim's value, else the newest."""
    return C.best_value(C.resolve_claims(W.line_rows(t)), ("returnflag", "discounted"))


@query(
    "e11_refresh_titles",
    """SELECT e.entity_id, coalesce(CASE WHEN v.top_values = 1 THEN v.newest_key END, e.title) AS title
       FROM entities e LEFT JOIN verdict v ON v.entity_id = e.entity_id AND v.field = 'returnflag'""",
    ("entities", "verdict"),
)
def e11(t: Tables) -> DataFrame:
    """Parts shown under their selected title claim; the return flag stands in for the title."""
    titled = W.line_claims(t).withColumn(
        "field", F.when(F.col("field") == "returnflag", "title").otherwise(F.col("field"))
    )
    resolved = C.resolve_claims(titled.filter("field = 'title'"))
    return C.refresh_titles(W.entities(t), resolved).select("entity_id", "title")


@query(
    "e12_retire_claims",
    """SELECT v.event_id AS claim_id, coalesce(v.ts >= c.last_at, TRUE) AS active,
       CASE WHEN v.ts < c.last_at THEN 'replaced' ELSE 'selected' END AS reason
       FROM (SELECT * FROM events WHERE event_type = 'view') v
       LEFT JOIN (SELECT user_id, max(ts) AS last_at FROM events WHERE event_type = 'signup' GROUP BY 1) c ON c.user_id = v.user_id""",
)
def e12(t: Tables) -> DataFrame:
    """Views stand for manual id claims, sign-ups for the commands that retire older ones."""
    manual = t.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("entity_id"), F.lit(None).cast("string").alias("raw_id"),
        F.lit(None).cast("string").alias("verification_id"), F.lit("official_job_id").alias("field"),
        F.col("event_id").alias("claim_id"), F.col("ts").alias("created_at"), F.lit(True).alias("active"),
        F.lit(True).alias("selected"), F.lit("selected").alias("reason"),
    )
    commands = t.events.filter("event_type = 'signup'").select(
        F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), F.lit("replaced").alias("reason")
    )
    return C.retire_claims(manual, commands).select("claim_id", "active", "reason")


def mixed_claims(t: Tables) -> DataFrame:
    """Imported, verified and manual claims together."""
    lines = W.line_claims(t)
    checks = W.attempts(t).select(
        "entity_id", F.lit(None).cast("string").alias("raw_id"), "verification_id", F.lit(30).alias("authority"),
        F.col("checked_at").alias("observed_at"), "created_at",
        F.concat_ws(":", F.lit("verification"), "scope", "domain").alias("source_key"), F.lit(True).alias("active"),
        F.lit("linestatus").alias("field"), F.col("result").alias("raw_value"), F.col("result").alias("value_key"),
        F.concat(F.lit("v:"), "verification_id").alias("claim_id"), F.lit(1.0).alias("confidence"),
    )
    views = t.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("entity_id"), F.lit(None).cast("string").alias("raw_id"),
        F.lit(None).cast("string").alias("verification_id"), F.lit(40).alias("authority"),
        F.col("ts").alias("observed_at"), F.col("ts").alias("created_at"), F.lit("manual:view").alias("source_key"),
        (F.col("value") > 5).alias("active"), F.lit("official_job_id").alias("field"),
        F.lit("x").alias("raw_value"), F.lit("x").alias("value_key"),
        F.concat(F.lit("m:"), F.col("event_id").cast("string")).alias("claim_id"), F.lit(1.0).alias("confidence"),
    )
    return lines.unionByName(checks).unionByName(views)


shared(
    "applicable",
    """SELECT c.claim_id, c.entity_id, c.field, c.value_key, c.authority, c.observed_at, c.source_key, coalesce(r.kind = e.kind, FALSE) AS applicable, TRUE AS active
       FROM claims c JOIN raw r ON r.raw_id = c.raw_id LEFT JOIN entities e ON e.entity_id = c.entity_id
       UNION ALL SELECT 'v:' || a.verification_id, a.entity_id, 'linestatus', a.result, 30, a.checked_at, 'verification:' || a.scope || ':' || a.domain,
         coalesce(a.scope = e.kind AND a.domain = CASE WHEN o.domain_verified THEN o.official_domain ELSE '' END, FALSE), TRUE
       FROM attempts a LEFT JOIN entities e ON e.entity_id = a.entity_id LEFT JOIN orgs o ON o.org_id = e.org_id
       UNION ALL SELECT 'm:' || v.event_id, v.user_id, 'official_job_id', 'x', 40, v.ts, 'manual:view',
         coalesce(v.value > 5 AND e.kind = 'POSTING', FALSE), v.value > 5
       FROM events v LEFT JOIN entities e ON e.entity_id = v.user_id WHERE v.event_type = 'view'""",
    "claims", "raw", "entities", "orgs", "attempts",
)


def scoped_claims(t: Tables) -> DataFrame:
    return C.applicable_claims(mixed_claims(t), W.raw(t), W.attempts(t), W.entities(t), W.orgs(t))


@query("d15_applicable_claims", "SELECT claim_id, entity_id, field, applicable FROM applicable", ("applicable",))
def d15(t: Tables) -> DataFrame:
    """Which claims still fit the kind and trust anchor of their entity."""
    return scoped_claims(t).select("claim_id", "entity_id", "field", "applicable")


@query(
    "e7_historical_labels",
    """SELECT a.field, a.applicable, NOT a.applicable AND a.active AS historical, 0 AS selected_out_of_scope, count(*) AS claims FROM applicable a GROUP BY ALL""",
    ("applicable",),
)
def e7_historical(t: Tables) -> DataFrame:
    """Claims out of scope are labelled as history and never selected."""
    resolved = C.resolve_claims(scoped_claims(t), counted=mixed_claims(t))
    return resolved.groupBy("field", "applicable", (F.col("reason") == C.HISTORICAL).alias("historical")).agg(
        F.count_if(F.col("selected") & ~F.col("applicable")).alias("selected_out_of_scope"), F.count("*").alias("claims")
    )


@query(
    "e13_claim_matrix",
    """SELECT l.entity_id, l.field, l.claim_id, l.authority, l.reason = 'selected' AS selected, l.reason, s.name AS source_name
       FROM labelled l JOIN raw r ON r.raw_id = l.raw_id JOIN sources s ON s.source_id = r.source_id""",
    ("labelled", "raw", "sources"),
)
def e13(t: Tables) -> DataFrame:
    """All claims with labels and source names, one line per claim."""
    resolved = C.resolve_claims(W.line_rows(t)).withColumn("applicable", F.lit(True))
    names = W.raw(t).join(W.sources(t).select("source_id", F.col("name").alias("source_name")), "source_id")
    return C.claim_matrix(resolved, names).select(
        "entity_id", "field", "claim_id", "authority", "selected", "reason", "source_name"
    )
