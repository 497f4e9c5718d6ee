"""The working tables as views over the driver's tables, each with the same view in SQL.

parts are entities of their brand, order lines are the raw rows that observe them, suppliers are
sources, events are official checks, orders are decision history and customers the shortlist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.claims import RowClaims, unpivot_claims
from accordant.plans.registry import Tables, shared

EVENTS_AS_OF = "2024-01-31 00:00:00"
EVENTS_MAX_AGE = 0.5
LINES_AS_OF = "2001-11-05 00:00:00"
LINES_MAX_AGE = 1200.0


def days(c: Column) -> Column:
    return F.make_dt_interval(days=c)


def line_id() -> Column:
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"


def line_authority() -> Column:
    return F.when(F.col("l_linenumber") == 7, 30).when(F.col("l_linenumber") >= 5, 20).otherwise(10)


LINE_AUTHORITY = "CASE WHEN l_linenumber = 7 THEN 30 WHEN l_linenumber >= 5 THEN 20 ELSE 10 END"


def line_rows(t: Tables, entity: str = "l_partkey", fields: dict[str, Column] | None = None) -> RowClaims:
    """The order lines that make line_claims: they are dealt out before their claims are made."""
    discounted = F.when(F.col("l_discount") == 0, "").otherwise("Y")
    keep = [
        F.col(entity).alias("entity_id"),
        line_id().alias("raw_id"),
        F.lit(None).cast("string").alias("verification_id"),
        line_authority().alias("authority"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_shipdate").alias("created_at"),
        F.concat(F.lit("raw:"), F.col("l_suppkey").cast("string")).alias("source_key"),
        F.lit(True).alias("active"),
    ]
    fields = fields or {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"), "discounted": discounted}

    def make(lines: DataFrame) -> DataFrame:
        claims = unpivot_claims(lines, keep, {name: (value, value) for name, value in fields.items()})
        return claims.withColumns(
            {"claim_id": F.concat_ws(":", "raw_id", "field"), "confidence": F.lit(1.0)}
        )

    return RowClaims(t.lineitem, entity, make, len(fields))


def line_claims(t: Tables, entity: str = "l_partkey", fields: dict[str, Column] | None = None) -> DataFrame:
    """Three fields (or those given) of every order line as claims about its part (or order)."""
    return line_rows(t, entity, fields).made()


def _claims_sql(entity: str) -> str:
    return f"""
SELECT {entity} AS entity_id, {LINE_ID} AS raw_id, CAST(NULL AS VARCHAR) AS verification_id,
       {LINE_AUTHORITY} AS authority, l_shipdate AS observed_at, l_shipdate AS created_at,
       'raw:' || l_suppkey AS source_key, f.field, f.v AS raw_value, f.v AS value_key,
       {LINE_ID} || ':' || f.field AS claim_id
FROM lineitem, LATERAL (VALUES ('returnflag', l_returnflag), ('linestatus', l_linestatus),
     ('discounted', CASE WHEN l_discount = 0 THEN '' ELSE 'Y' END)) AS f(field, v)"""


shared("claims", _claims_sql("l_partkey"))
shared("order_claims", _claims_sql("l_orderkey"))


def resolution_sql(claims: str, prefix: str = "") -> None:
    """Resolution in windows: latest per source, top authority, agreement."""
    shared(
        f"{prefix}latest",
        f"""SELECT entity_id, field, source_key, m.o AS observed_at, m.c AS created_at, m.i AS claim_id, m.a AS authority, m.v AS value_key FROM (
            SELECT entity_id, field, source_key, max(struct_pack(o := observed_at, c := created_at, i := claim_id, a := authority, v := value_key)) AS m
            FROM {claims} WHERE value_key <> '' GROUP BY ALL)""",
        claims,
    )
    shared(
        f"{prefix}top",
        f"""SELECT *, max(authority) OVER (PARTITION BY entity_id, field) AS top_authority FROM {prefix}latest""",
        f"{prefix}latest",
    )
    shared(
        f"{prefix}verdict",
        f"""SELECT entity_id, field, any_value(top_authority) AS top_authority, count(*) AS sources,
            count(DISTINCT value_key) FILTER (WHERE authority = top_authority) AS top_values,
            arg_max(claim_id, struct_pack(o := observed_at, c := created_at, i := claim_id)) FILTER (WHERE authority = top_authority) AS newest_id,
            arg_max(value_key, struct_pack(o := observed_at, c := created_at, i := claim_id)) FILTER (WHERE authority = top_authority) AS newest_key,
            arg_max(observed_at, struct_pack(o := observed_at, c := created_at, i := claim_id)) FILTER (WHERE authority = top_authority) AS newest_at
            FROM {prefix}top GROUP BY ALL""",
        f"{prefix}top",
    )
    shared(
        f"{prefix}labelled",
        f"""SELECT c.*, CASE WHEN v.entity_id IS NULL THEN 'all_missing' WHEN c.value_key = '' THEN ''
              WHEN l.claim_id IS NULL THEN 'superseded'
              WHEN v.top_values > 1 THEN CASE WHEN c.authority = v.top_authority THEN 'conflict' ELSE 'higher_authority_unresolved' END
              WHEN c.claim_id = v.newest_id THEN 'selected' WHEN c.value_key = v.newest_key THEN 'agrees'
              WHEN c.authority < v.top_authority THEN 'overridden' ELSE '' END AS reason
            FROM {claims} c LEFT JOIN {prefix}verdict v ON v.entity_id = c.entity_id AND v.field = c.field
            LEFT JOIN {prefix}latest l ON l.claim_id = c.claim_id""",
        f"{prefix}verdict",
    )


resolution_sql("claims")
resolution_sql("order_claims", "order_")


def orgs(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct().select(
        F.col("p_brand").alias("org_id"),
        F.col("p_brand").alias("canonical_name"),
        F.lower("p_brand").alias("normalized_name"),
        F.lit("").alias("candidate_domain"),
        F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example.com")).alias("official_domain"),
        F.lit("").alias("scope_path"),
        (F.col("p_brand") < "Brand#4").alias("domain_verified"),
    )


shared(
    "orgs",
    """SELECT DISTINCT p_brand AS org_id, p_brand AS canonical_name, lower(p_brand) AS normalized_name,
       replace(lower(p_brand), '#', '') || '.example.com' AS official_domain, '' AS scope_path,
       p_brand < 'Brand#4' AS domain_verified FROM part""",
)


def entities(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_brand").alias("org_id"),
        F.when(F.col("p_type") == "PROMO", "CAMPAIGN").otherwise("POSTING").alias("kind"),
        F.col("p_name").alias("title"),
        F.when(size >= 10, F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("official_job_id"),
        F.lit(None).cast("string").alias("canonical_key"),
        F.when(size == 50, "MERGED").when(size < 10, "REVIEW").otherwise("PENDING").alias("review_status"),
        F.lit("1998-01-01").cast("timestamp").alias("created_at"),
        (F.lit("1998-01-01").cast("timestamp") + days(size)).alias("updated_at"),
    )


shared(
    "entities",
    """SELECT p_partkey AS entity_id, p_brand AS org_id, CASE WHEN p_type = 'PROMO' THEN 'CAMPAIGN' ELSE 'POSTING' END AS kind,
       p_name AS title, CASE WHEN p_size >= 10 THEN 'P-' || p_partkey END AS official_job_id,
       CASE WHEN p_size = 50 THEN 'MERGED' WHEN p_size < 10 THEN 'REVIEW' ELSE 'PENDING' END AS review_status,
       TIMESTAMP '1998-01-01' AS created_at, TIMESTAMP '1998-01-01' + to_days(p_size) AS updated_at FROM part""",
)


def batch_id() -> Column:
    return F.concat_ws("-", "l_suppkey", F.year("l_shipdate"))


def raw(t: Tables) -> DataFrame:
    return t.lineitem.select(
        line_id().alias("raw_id"),
        batch_id().alias("batch_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("entity_id"),
        F.when(F.col("l_returnflag") == "R", "CAMPAIGN").otherwise("POSTING").alias("kind"),
        F.col("l_shipdate").alias("created_at"),
    )


shared(
    "raw",
    f"""SELECT {LINE_ID} AS raw_id, l_suppkey || '-' || year(l_shipdate) AS batch_id, l_suppkey AS source_id,
        l_partkey AS entity_id, CASE WHEN l_returnflag = 'R' THEN 'CAMPAIGN' ELSE 'POSTING' END AS kind,
        l_shipdate AS created_at FROM lineitem""",
)


def origins(t: Tables) -> DataFrame:
    return raw(t).select("entity_id", "raw_id")


def batches(t: Tables) -> DataFrame:
    """One batch per supplier and year."""
    return t.lineitem.groupBy(batch_id().alias("batch_id"), F.col("l_suppkey").alias("source_id")).agg(
        F.max("l_shipdate").alias("snapshot_at"),
        (F.max("l_shipdate") + days(F.lit(1))).alias("imported_at"),
        F.count("*").alias("row_count"),
    )


shared(
    "batches",
    """SELECT l_suppkey || '-' || year(l_shipdate) AS batch_id, l_suppkey AS source_id, max(l_shipdate) AS snapshot_at,
       max(l_shipdate) + to_days(1) AS imported_at, count(*) AS row_count FROM lineitem GROUP BY 1, 2""",
)


def sources(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("source_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "OFFICIAL").otherwise("PAID_TABLE").alias("kind"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("independence_group"),
    )


shared(
    "sources",
    """SELECT s_suppkey AS source_id, s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'OFFICIAL' ELSE 'PAID_TABLE' END AS kind,
       'n' || s_nationkey AS independence_group FROM supplier""",
)


def event_result() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "purchase", "OPEN").when(kind == "error", "BLOCKED").when(kind == "signup", "NOT_FOUND").when(
        kind == "click", "CLOSED"
    )


def attempts(t: Tables) -> DataFrame:
    """Every event but a view is an official check of the part with the user's number.

    The `k` property says how good the check was: low values were made against an older domain.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    brand = t.part.select(
        F.col("p_partkey").alias("user_id"),
        F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example.com")).alias("own_domain"),
    )
    domain = F.when(k < 20, "old.example.com").otherwise(F.coalesce("own_domain", F.lit("none.example.com")))
    job = F.concat(F.lit("P-"), F.col("user_id").cast("string"), F.when(k >= 90, "0").otherwise(""))
    return (
        t.events.filter("event_type <> 'view'")
        .join(brand, "user_id", "left")
        .select(
            F.col("event_id").cast("string").alias("verification_id"),
            F.col("user_id").alias("entity_id"),
            event_result().alias("result"),
            F.when(k < 30, "CAMPAIGN").otherwise("POSTING").alias("scope"),
            domain.alias("domain"),
            F.lit("").alias("scope_path"),
            F.concat(F.lit("https://"), domain, F.lit("/jobs/"), job).alias("url"),
            F.lit("").alias("final_url"),
            F.col("ts").alias("checked_at"),
            F.col("ts").alias("created_at"),
        )
    )


shared(
    "attempts",
    """SELECT CAST(event_id AS VARCHAR) AS verification_id, user_id AS entity_id,
       CASE event_type WHEN 'purchase' THEN 'OPEN' WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'NOT_FOUND' WHEN 'click' THEN 'CLOSED' END AS result,
       CASE WHEN k < 30 THEN 'CAMPAIGN' ELSE 'POSTING' END AS scope,
       CASE WHEN k < 20 THEN 'old.example.com' ELSE coalesce(own_domain, 'none.example.com') END AS domain, '' AS scope_path,
       'P-' || user_id || CASE WHEN k >= 90 THEN '0' ELSE '' END AS url_job,
       ts AS checked_at, ts AS created_at
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'view') e
       LEFT JOIN (SELECT p_partkey, replace(lower(p_brand), '#', '') || '.example.com' AS own_domain FROM part) p ON p.p_partkey = e.user_id""",
)
shared(
    "scoped",
    """SELECT a.*, e.kind, e.official_job_id FROM attempts a JOIN entities e ON e.entity_id = a.entity_id
       JOIN orgs o ON o.org_id = e.org_id
       WHERE o.domain_verified AND a.scope = e.kind AND a.domain = o.official_domain AND a.scope_path = o.scope_path""",
    "attempts", "entities", "orgs",
)
shared(
    "effective",
    """SELECT entity_id, verification_id, result, checked_at FROM (
         SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY checked_at DESC, created_at DESC, verification_id DESC) AS rn
         FROM scoped WHERE kind <> 'POSTING' OR lower(official_job_id) = lower(url_job)) WHERE rn = 1""",
    "scoped",
)


def decisions(t: Tables) -> DataFrame:
    """Orders as decision history of the part with the customer's number."""
    rank = F.substring("o_orderpriority", 1, 1)
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").cast("string").alias("decision_id"),
        F.when(rank <= "2", "PASS").when(rank == "5", "FAIL").otherwise("UNKNOWN").alias("eligibility"),
        F.when(rank == "1", "PRIMARY").when(rank == "2", "APPLY").otherwise("LOW").alias("evidence_fit"),
        F.when(status == "F", "VERIFIED").when(status == "O", "CONFLICTED").otherwise("CONSISTENT").alias("trust"),
        F.col("o_orderpriority").alias("fingerprint"),
        (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).alias("is_current"),
        F.when(F.col("o_totalprice") > 400000, "HOLD")
        .when(F.col("o_totalprice") > 300000, "VERIFY_FIRST")
        .otherwise("UNDECIDED")
        .alias("manual"),
        F.lit("").alias("override_reason"),
        F.col("o_orderdate").alias("created_at"),
    )


shared(
    "decisions",
    """SELECT o_custkey AS entity_id, CAST(o_orderkey AS VARCHAR) AS decision_id,
       CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 'PASS' WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'FAIL' ELSE 'UNKNOWN' END AS eligibility,
       CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'PRIMARY' WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'APPLY' ELSE 'LOW' END AS evidence_fit,
       CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'CONFLICTED' ELSE 'CONSISTENT' END AS trust,
       o_orderpriority AS fingerprint, o_orderdate >= TIMESTAMP '2000-01-01' AS is_current,
       CASE WHEN o_totalprice > 400000 THEN 'HOLD' WHEN o_totalprice > 300000 THEN 'VERIFY_FIRST' ELSE 'UNDECIDED' END AS manual,
       '' AS override_reason, o_orderdate AS created_at FROM orders""",
)
shared(
    "current",
    """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, decision_id DESC) AS rn
       FROM decisions WHERE is_current) WHERE rn = 1""",
    "decisions",
)

STAGE_OF = {
    "AUTOMOBILE": "TO_APPLY", "BUILDING": "APPLIED", "FURNITURE": "INTERVIEW", "HOUSEHOLD": "OFFER", "MACHINERY": "WITHDRAWN",
}


def shortlist(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    stage = F.lit("TO_APPLY")
    for name, value in STAGE_OF.items():
        stage = F.when(segment == name, value).otherwise(stage)
    start = F.lit("1999-01-01").cast("timestamp")
    return t.customer.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_nationkey").alias("priority"),
        segment.alias("note"),
        stage.alias("stage"),
        F.lit("").alias("next_action"),
        F.lit(None).cast("timestamp").alias("next_action_at"),
        F.lit(None).cast("timestamp").alias("applied_at"),
        (start + days(F.col("c_nationkey"))).alias("added_at"),
    )


shared(
    "shortlist",
    "SELECT c_custkey AS entity_id, c_nationkey AS priority, c_mktsegment AS note, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items())
    + " ELSE 'TO_APPLY' END AS stage, TIMESTAMP '1999-01-01' + to_days(c_nationkey) AS added_at FROM customer",
)
