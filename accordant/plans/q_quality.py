"""Quality reports, seals and label comparison."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import claims as C, quality as Q
from accordant.plans import workspace as W
from accordant.plans.q_serving import scoped
from accordant.plans.registry import Tables, query
from accordant.plans.q_snapshots import FINGERPRINT

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
AUDIT = dataclasses.replace(
    R.AuditRules(),
    separators="[ ]",
    generic_markers=("old", "ring"),
    date_pattern="^199[0-9]-[0-9]{2}-[0-9]{2}$",
    url_pattern="<(https?://[^>]+)>",
    target_year="2000",
    target_city="1",
    target_keywords=("red", "BLUE"),
)


@query("j1_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in TABLES))
def j1(t: Tables) -> DataFrame:
    """Lines of every table."""
    return Q.table_counts({name: getattr(t, name) for name in TABLES})


@query(
    "j2_distributions",
    """SELECT 'kind' AS name, kind AS value, count(*) AS rows FROM entities GROUP BY 2 UNION ALL
       SELECT 'review_status', review_status, count(*) FROM entities GROUP BY 2 UNION ALL
       SELECT 'raw_kind', kind, count(*) FROM raw GROUP BY 2 UNION ALL
       SELECT 'verification_result', result, count(*) FROM attempts GROUP BY 2 UNION ALL
       SELECT 'current_trust', trust, count(*) FROM decisions WHERE is_current GROUP BY 2""",
    ("entities", "raw", "attempts", "decisions"),
)
def j2(t: Tables) -> DataFrame:
    """Value counts of the working tables."""
    return Q.distributions(
        [
            ("kind", W.entities(t), "kind", None),
            ("review_status", W.entities(t), "review_status", None),
            ("raw_kind", W.raw(t), "kind", None),
            ("verification_result", W.attempts(t), "result", None),
            ("current_trust", W.decisions(t), "trust", "is_current"),
        ]
    )


@query(
    "j2_more_distributions",
    """SELECT 'source_kind' AS name, kind AS value, count(*) AS rows FROM sources GROUP BY 2 UNION ALL
       SELECT 'claim_field', field, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'claim_reason', reason, count(*) FROM labelled GROUP BY 2 UNION ALL
       SELECT 'application_stage', stage, count(*) FROM shortlist GROUP BY 2 UNION ALL SELECT 'current_eligibility', eligibility, count(*) FROM decisions WHERE is_current GROUP BY 2 UNION ALL
       SELECT 'current_evidence_fit', evidence_fit, count(*) FROM decisions WHERE is_current GROUP BY 2 UNION ALL
       SELECT 'current_manual', manual, count(*) FROM decisions WHERE is_current GROUP BY 2""",
    ("sources", "claims", "labelled", "shortlist", "decisions"),
)
def j2_more(t: Tables) -> DataFrame:
    """Value counts of sources, claims, stages and the rest of a current decision."""
    claims, past = C.resolve_claims(W.line_rows(t)), W.decisions(t)
    return Q.distributions(
        [
            ("source_kind", W.sources(t), "kind", None),
            ("claim_field", claims, "field", None),
            ("claim_reason", claims, "reason", None),
            ("application_stage", W.shortlist(t), "stage", None),
            ("current_eligibility", past, "eligibility", "is_current"),
            ("current_evidence_fit", past, "evidence_fit", "is_current"),
            ("current_manual", past, "manual", "is_current"),
        ]
    )


@query(
    "j3_lineage_coverage",
    """SELECT 'raw' AS scope, count(*) AS total, count(*) FILTER (WHERE kind = 'POSTING') AS linked, count(*) FILTER (WHERE kind <> 'POSTING') AS unlinked,
         round(count(*) FILTER (WHERE kind = 'POSTING') / count(*), 6) AS coverage FROM raw
       UNION ALL SELECT 'entity', count(*), count(l.entity_id), count(*) - count(l.entity_id), round(count(l.entity_id) / count(*), 6) FROM entities e
       LEFT JOIN (SELECT DISTINCT entity_id FROM raw WHERE kind = 'POSTING') l ON l.entity_id = e.entity_id""",
    ("raw", "entities"),
)
def j3(t: Tables) -> DataFrame:
    """Rows and parts with an origin, when only posting rows are linked."""
    origins = W.raw(t).filter("kind = 'POSTING'").select("entity_id", "raw_id")
    return Q.lineage_coverage(W.raw(t), W.entities(t), origins)


@query(
    "j4_uniqueness_violations",
    """SELECT 'current_decisions' AS check_name, count(*) AS violations FROM (SELECT entity_id FROM decisions WHERE is_current GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'selected_claims', count(*) FROM (SELECT entity_id, field FROM labelled WHERE reason = 'selected' GROUP BY 1, 2 HAVING count(*) > 1)""",
    ("decisions", "labelled"),
)
def j4(t: Tables) -> DataFrame:
    """Entities with several current decisions, and fields with several selected claims."""
    current = Q.uniqueness_violations(W.decisions(t), ["entity_id"], "is_current")
    selected = Q.uniqueness_violations(C.resolve_claims(W.line_rows(t)), C.GROUP, "selected")
    return current.select(F.lit("current_decisions").alias("check_name"), "violations").unionByName(
        selected.select(F.lit("selected_claims").alias("check_name"), "violations")
    )


@query(
    "j5_verification_counts",
    "SELECT (SELECT count(*) FROM orgs WHERE domain_verified) AS verified_domains, (SELECT count(*) FROM scoped) AS in_scope_attempts",
    ("orgs", "scoped"),
)
def j5(t: Tables) -> DataFrame:
    """Verified domains and checks in scope."""
    return Q.verification_counts(scoped(t), W.orgs(t))


@query(
    "j6_supplier_audit",
    """SELECT count(*) AS job_rows, count(*) FILTER (WHERE m) AS multi_role, count(*) FILTER (WHERE c) AS multi_city, count(*) FILTER (WHERE d) AS unclear_deadline,
         count(*) FILTER (WHERE u) AS with_url, round(count(*) FILTER (WHERE m) * 100 / count(*), 1) AS multi_role_percent, round(count(*) FILTER (WHERE c) * 100 / count(*), 1) AS multi_city_percent,
         round(count(*) FILTER (WHERE d) * 100 / count(*), 1) AS unclear_deadline_percent, round(count(*) FILTER (WHERE u) * 100 / count(*), 1) AS with_url_percent, count(*) FILTER (WHERE g) AS target_rows
       FROM (SELECT regexp_matches(p_name, 'old|ring') AS m, l_linenumber > 4 AS c, l_linestatus = 'O' OR year(l_shipdate) > 1999 AS d, l_returnflag = 'R' AS u,
               year(l_shipdate) = 2000 AND (l_linenumber = 1 OR contains('x' || l_suppkey, '1')) AND (contains(p_name, 'red') OR contains(p_name, 'blue')) AS g
             FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#7')""",
)
def j6(t: Tables) -> DataFrame:
    """Heuristic shares over all order lines with their part's name."""
    line = F.col("l_linenumber").cast("string")
    supplier = F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.when(F.col("p_brand") == "Brand#7", "本表正版授权").otherwise(F.col("p_brand")).alias("company"),
        F.col("p_name").alias("title"),
        F.when(F.col("l_linenumber") > 4, F.concat(supplier, F.lit(" z"))).when(F.col("l_linenumber") == 1, F.concat(supplier, F.lit("1"))).otherwise(supplier).alias("cities_text"),
        F.year("l_shipdate").cast("string").alias("years_text"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("deadline"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<https://e.example/"), line, F.lit(">"))).otherwise("-").alias("link_text"),
    )
    return Q.supplier_audit(rows, AUDIT)


@query(
    "j6_top_values",
    "SELECT l_suppkey::VARCHAR AS value, count(*) AS rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
)
def j6_top(t: Tables) -> DataFrame:
    """The eight suppliers with most lines."""
    return Q.top_values(t.lineitem.withColumn("s", F.col("l_suppkey").cast("string")), "s")


@query(
    "j8_content_seal",
    f"""SELECT 'sha256:' || sha256(string_agg(table_name || '=' || n || '=' || fingerprint, chr(10) ORDER BY table_name)) AS seal FROM (
        SELECT 'events' AS table_name, count(*) AS n, {FINGERPRINT.format("event_id || '|' || event_type || '|' || props")} AS fingerprint FROM events
        UNION ALL SELECT 'orders', count(*), {FINGERPRINT.format("o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority")} FROM orders)""",
)
def j8(t: Tables) -> DataFrame:
    """One seal over two whole tables, whatever their row order."""
    keys = {
        "events": F.concat_ws("|", "event_id", "event_type", "props"),
        "orders": F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"),
    }
    return Q.content_seal(Q.table_seals({"events": t.events, "orders": t.orders}, keys))


@query(
    "j9_disallowed_sources",
    "SELECT source_id, name, kind FROM sources WHERE kind <> 'PAID_TABLE' ORDER BY name, source_id LIMIT 3",
    ("sources",),
)
def j9(t: Tables) -> DataFrame:
    """The first sources that may not be published."""
    return Q.disallowed_sources(W.sources(t), ["PAID_TABLE"])


@query(
    "j10_compare_labels",
    """SELECT lang, count(*) AS cases, count(*) FILTER (WHERE quality = CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS passed,
       round(avg(CASE WHEN quality = CASE WHEN n_chars > 500 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
       FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""",
)
def j10(t: Tables) -> DataFrame:
    """Quality labels against a rule on the length, per language."""
    actual = t.documents.select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("label"))
    expected = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("label"))
    return Q.compare_labels(expected, actual, "doc_id", "lang")


@query(
    "j11_latency_stats",
    """SELECT event_type, count(*) AS samples, round(min(value), 4) AS min, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95,
       round(max(value), 4) AS max FROM events GROUP BY 1""",
)
def j11(t: Tables) -> DataFrame:
    """Exact percentiles of event values."""
    return Q.latency_stats(t.events, "value", "event_type")


@query(
    "j12_append_events",
    """SELECT 'order' AS entity_type, CAST(o_orderkey AS VARCHAR) AS entity_id, 'IMPORTED' AS event_type, 'system' AS actor, '{"status":"' || o_orderstatus || '"}' AS payload FROM orders
       UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), event_type, 'log', props FROM events""",
)
def j12(t: Tables) -> DataFrame:
    """The event log with one audit line per order added."""
    log = t.events.select(
        F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), "event_type",
        F.lit("log").alias("actor"), F.col("props").alias("payload"), F.col("ts").alias("created_at"),
    )
    new = t.orders.select(
        F.lit("order").alias("entity_type"), F.col("o_orderkey").alias("entity_id"), F.lit("IMPORTED").alias("event_type"),
        F.col("o_orderdate").alias("created_at"), F.struct(F.col("o_orderstatus").alias("status")).alias("payload"),
    )
    return Q.append_events(log, new).select("entity_type", "entity_id", "event_type", "actor", "payload")
