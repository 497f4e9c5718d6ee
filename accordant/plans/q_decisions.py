"""Three-axis decisions over orders as postings and customers as profiles, and decision history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import claims as C, decisions as D, entities as E, facts as T, verification as V
from accordant.plans import workspace as W
from accordant.plans.registry import Tables, query, shared

AS_OF = "2001-08-02 00:00:00"
RULES = R.DecisionRules(
    dictionary={"alpha": ("alpha",), "beta": ("beta", "MEDIUM"), "rush": ("URGENT",)},
    education_rank=(("LOW", 1), ("MEDIUM", 2), ("HIGH", 3)),
    anywhere="5",
    max_age_days=900.0,
    generic_values=("1-URGENT",),
)


def order_facts(t: Tables) -> DataFrame:
    """Every order is a fact about its customer; pending ones are not confirmed."""
    rank = F.substring("o_orderpriority", 1, 1)
    kind = (
        F.when(rank == "1", "SKILL").when(rank == "2", "GRADUATION_YEAR").when(rank == "3", "EDUCATION").when(rank == "4", "PROJECT").otherwise("EXPERIENCE")
    )
    status = F.col("o_orderstatus")
    value = (
        F.when(rank == "2", F.concat(F.year("o_orderdate").cast("string"), F.lit("届")))
        .when(rank == "3", F.when(status == "F", "HIGH").otherwise("LOW"))
        .otherwise(F.col("o_orderpriority"))
    )
    return t.orders.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("fact_id"),
        F.col("o_custkey").alias("profile_id"),
        kind.alias("kind"),
        value.alias("value"),
        F.when(status == "F", "alpha work").when(status == "O", "beta work").otherwise("gamma").alias("evidence"),
        F.year("o_orderdate").alias("start"),
        (F.year("o_orderdate") + 1).alias("end"),
        (status != "P").alias("confirmed"),
    )


def customer_wishes(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    cities = F.when(segment == "BUILDING", F.array(F.lit("1"), F.lit("2"))).when(segment == "AUTOMOBILE", F.array(F.lit("3")))
    types = F.when(segment == "MACHINERY", F.array(F.lit("秋招"))).when(segment == "HOUSEHOLD", F.array(F.lit("实习"), F.lit("补录"))).otherwise(
        F.array(F.lit("其他"))
    )
    hard = (F.col("c_acctbal") > 0).alias("hard_constraint")

    def wish(key: str, value) -> DataFrame:
        return t.customer.select(F.col("c_custkey").alias("profile_id"), F.lit(key).alias("key"), value.alias("value"), hard, F.lit(True).alias("confirmed"))

    return wish("accepted_cities", cities).filter("value is not null").unionByName(wish("accepted_recruitment_types", types))


def profiles(t: Tables) -> DataFrame:
    return T.load_profiles(order_facts(t), customer_wishes(t), RULES)


def order_contexts(t: Tables) -> DataFrame:
    """Every order as a posting its own customer looks at."""
    rank, status, price = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.col("o_totalprice")
    none = F.array().cast("array<string>")
    return t.orders.select(
        F.col("o_orderkey").alias("entity_id"),
        F.col("o_custkey").alias("profile_id"),
        F.when(rank == "4", "CAMPAIGN").otherwise("POSTING").alias("kind"),
        F.lit("PENDING").alias("review_status"),
        F.lit("c").alias("company"),
        F.col("o_orderpriority").alias("title"),
        F.when(price > 480000, none).otherwise(F.array(rank)).alias("cities"),
        F.when(price > 460000, none).otherwise(F.array(F.concat(F.year("o_orderdate").cast("string"), F.lit("届")))).alias("graduation_years"),
        F.array(F.col("o_orderpriority")).alias("education"),
        F.when(status == "F", "2000秋招").when(status == "O", "实习").otherwise("").alias("recruitment_type"),
        F.when(price < 100000, "alpha beta").when(price < 200000, "alpha").when(price < 300000, "beta and rush URGENT").otherwise("none").alias("jd_text"),
        F.when(status == "F", "OPEN").when(status == "O", "CLOSED").when(price > 400000, "BLOCKED").otherwise("UNKNOWN").alias("verification_result"),
        F.when(status == "F", F.col("o_orderdate")).alias("official_checked_at"),
        F.when(price > 250000, 2).otherwise(1).alias("source_count"),
        ((rank != "4") & (status != "P")).alias("official_specific_posting"),
        F.col("o_orderdate").alias("latest_source_at"),
        F.when(price > 350000, F.array(F.lit("deadline"))).otherwise(none).alias("conflicting_fields"),
    )


shared(
    "order_facts",
    """SELECT 'f' || o_orderkey AS fact_id, o_custkey AS profile_id, o_orderstatus <> 'P' AS confirmed, substr(o_orderpriority, 1, 1) AS r, year(o_orderdate) AS y,
       o_orderstatus AS s, o_orderpriority AS p FROM orders""",
)
shared(
    "profiles",
    """SELECT c_custkey AS profile_id, c_mktsegment AS seg, c_acctbal > 0 AS hard,
       coalesce(list(DISTINCT y) FILTER (WHERE confirmed AND r = '2'), []) AS years,
       max(CASE WHEN confirmed AND r = '3' THEN CASE s WHEN 'F' THEN 3 ELSE 1 END END) AS degree,
       coalesce(bool_or(confirmed AND r IN ('1', '4', '5')), FALSE) AS has_evidence,
       coalesce(list(DISTINCT y) FILTER (WHERE confirmed AND r IN ('1', '4', '5') AND s = 'F'), []) AS alpha,
       coalesce(list(DISTINCT y) FILTER (WHERE confirmed AND r IN ('1', '4', '5') AND s = 'O'), []) AS beta,
       coalesce(list(DISTINCT y) FILTER (WHERE confirmed AND r = '1'), []) AS rush
       FROM customer LEFT JOIN order_facts ON profile_id = c_custkey GROUP BY 1, 2, 3""",
    "order_facts",
)
shared(
    "order_checks",
    """SELECT o_orderkey AS entity_id, o_orderpriority, o_orderstatus AS s, o_totalprice AS price, o_orderdate, substr(o_orderpriority, 1, 1) AS r, p.*,
       CASE WHEN NOT hard THEN [] WHEN seg = 'BUILDING' THEN ['1', '2'] WHEN seg = 'AUTOMOBILE' THEN ['3'] ELSE [] END AS accepted,
       CASE WHEN NOT hard THEN [] WHEN seg = 'MACHINERY' THEN ['校招'] WHEN seg = 'HOUSEHOLD' THEN ['实习', '补录'] ELSE ['其他'] END AS types,
       CASE o_orderstatus WHEN 'F' THEN '校招' WHEN 'O' THEN '实习' ELSE '' END AS offered,
       CASE WHEN o_orderpriority LIKE '%LOW' THEN 1 WHEN o_orderpriority LIKE '%MEDIUM' THEN 2 WHEN o_orderpriority LIKE '%HIGH' THEN 3 END AS floor
       FROM orders LEFT JOIN profiles p ON p.profile_id = o_custkey""",
    "profiles",
)
shared(
    "eligibility",
    """SELECT entity_id, CASE WHEN r = '4' THEN 'UNKNOWN'
         WHEN s = 'O' OR (len(accepted) > 0 AND price <= 480000 AND NOT (r = '5' OR list_contains(accepted, r)))
           OR (len(years) > 0 AND price <= 460000 AND NOT list_contains(years, year(o_orderdate)))
           OR (degree IS NOT NULL AND floor IS NOT NULL AND degree < floor)
           OR (len(types) > 0 AND offered <> '' AND NOT list_contains(types, offered)) THEN 'FAIL'
         WHEN s = 'P' OR len(accepted) = 0 OR price > 480000 OR len(years) = 0 OR price > 460000 OR degree IS NULL OR floor IS NULL OR len(types) = 0 OR offered = '' THEN 'UNKNOWN'
         ELSE 'PASS' END AS eligibility,
       CASE WHEN r = '4' THEN 'posting_required' ELSE concat_ws(',', CASE WHEN s = 'P' THEN 'status_not_confirmed' END, CASE WHEN len(accepted) = 0 THEN 'accepted_cities_missing' WHEN price > 480000 THEN 'posting_city_missing' END,
         CASE WHEN len(years) = 0 THEN 'candidate_graduation_unconfirmed' WHEN price > 460000 THEN 'posting_graduation_missing' END,
         CASE WHEN degree IS NULL THEN 'candidate_education_unconfirmed' WHEN floor IS NULL THEN 'posting_education_missing' END,
         CASE WHEN len(types) = 0 THEN 'accepted_recruitment_types_missing' WHEN offered = '' THEN 'posting_recruitment_type_missing' END) END AS unknowns
       FROM order_checks""",
    "order_checks",
)


def judged(t: Tables, axis: str) -> DataFrame:
    expression = {"eligibility": D.eligibility(RULES), "evidence_fit": D.evidence_fit(RULES), "trust": D.trust(AS_OF, RULES)}[axis]
    rows = D.with_profiles(order_contexts(t), profiles(t)).withColumn("d", expression)
    return rows.select(
        "entity_id", F.col("d.result").alias(axis), F.concat_ws(",", F.transform("d.unknowns", lambda u: u["code"])).alias("unknowns"),
        F.concat_ws(",", F.transform("d.reasons", lambda r: r["code"])).alias("reasons"),
        F.size(F.array_distinct(F.flatten(F.transform("d.reasons", lambda r: r["refs"])))).alias("refs"),
    )


@query("h2_eligibility", "SELECT entity_id, eligibility, unknowns FROM eligibility", ("eligibility",))
def h2(t: Tables) -> DataFrame:
    """Whether each order suits its customer, and what is unknown."""
    return judged(t, "eligibility").select("entity_id", "eligibility", "unknowns")


shared(
    "fit",
    """SELECT entity_id, CASE WHEN len(need) = 0 OR NOT has_evidence THEN 'UNKNOWN' WHEN len(got) = 0 THEN 'LOW'
         WHEN len(got) >= 3 AND len(got) * 1.0 / len(need) >= 0.6 AND spans >= 2 THEN 'PRIMARY'
         WHEN len(got) >= 2 OR len(got) * 1.0 / len(need) >= 0.5 THEN 'APPLY' ELSE 'STRETCH' END AS evidence_fit,
       CASE WHEN len(need) > 0 AND has_evidence THEN CASE WHEN len(got) = 0 THEN 'no_supported_capability_match' ELSE array_to_string(list_transform(got, lambda x: 'supported_capability_match:' || x), ',') END ELSE '' END AS reasons
       FROM (SELECT *, len(list_distinct(list_concat(CASE WHEN list_contains(got, 'alpha') THEN alpha ELSE [] END, list_concat(CASE WHEN list_contains(got, 'beta') THEN beta ELSE [] END, CASE WHEN list_contains(got, 'rush') THEN rush ELSE [] END)))) AS spans
         FROM (SELECT *, list_filter(need, lambda x: CASE x WHEN 'alpha' THEN len(alpha) > 0 WHEN 'beta' THEN len(beta) > 0 ELSE len(rush) > 0 END) AS got FROM (
           SELECT *, list_filter([CASE WHEN price < 200000 THEN 'alpha' END,
             CASE WHEN price < 100000 OR (price >= 200000 AND price < 300000) OR r = '3' THEN 'beta' END,
             CASE WHEN (price >= 200000 AND price < 300000) OR r = '1' THEN 'rush' END], lambda x: x IS NOT NULL) AS need FROM order_checks)))""",
    "order_checks",
)


@query("h3_evidence_fit", "SELECT entity_id, evidence_fit, reasons FROM fit", ("fit",))
def h3(t: Tables) -> DataFrame:
    """How far the customer's confirmed facts cover what the order asks for."""
    return judged(t, "evidence_fit").select("entity_id", "evidence_fit", "reasons")


shared(
    "trusted",
    f"""SELECT o_orderkey AS entity_id, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'UNKNOWN'
          WHEN o_orderdate < TIMESTAMP '{AS_OF}' - to_days(900) THEN 'STALE'
          WHEN o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '4%' THEN CASE WHEN o_totalprice > 350000 THEN 'VERIFIED_WITH_CONFLICT' ELSE 'VERIFIED' END
          WHEN o_totalprice > 350000 THEN 'CONFLICTED' WHEN o_totalprice > 250000 THEN 'CONSISTENT' ELSE 'UNKNOWN' END AS trust FROM orders""",
)


@query("h4_trust", "SELECT entity_id, trust FROM trusted", ("trusted",))
def h4(t: Tables) -> DataFrame:
    """What the evidence of each order is worth."""
    return judged(t, "trust").select("entity_id", "trust")


@query(
    "h5_decide",
    "SELECT e.entity_id, e.eligibility, f.evidence_fit, t.trust FROM eligibility e JOIN fit f ON f.entity_id = e.entity_id JOIN trusted t ON t.entity_id = e.entity_id",
    ("eligibility", "fit", "trusted"),
)
def h5(t: Tables) -> DataFrame:
    """All three axes of every order."""
    made = D.decide(order_contexts(t), profiles(t), AS_OF, RULES)
    kept = made.filter(F.col("fingerprint").rlike("^v1[|]profile:[0-9a-f]{16}$"))
    return kept.select("entity_id", "eligibility", "evidence_fit", "trust")


@query(
    "h5_decide_codes",
    """SELECT e.entity_id, e.eligibility, e.unknowns AS eligibility_unknowns, f.evidence_fit, f.reasons AS fit_reasons, t.trust,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'official_blocked' WHEN t.trust = 'STALE' THEN 'evidence_stale'
           WHEN t.trust = 'VERIFIED_WITH_CONFLICT' THEN 'official_posting_with_conflicts' WHEN t.trust = 'VERIFIED' THEN 'official_specific_posting_verified'
           WHEN t.trust = 'CONFLICTED' THEN 'unresolved_source_conflicts' WHEN t.trust = 'CONSISTENT' THEN 'multiple_sources_consistent' ELSE '' END AS trust_reasons,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'official_status_unresolved' WHEN t.trust = 'CONSISTENT' THEN 'official_posting_not_verified'
           WHEN t.trust = 'UNKNOWN' THEN 'insufficient_source_evidence' ELSE '' END AS trust_unknowns
       FROM eligibility e JOIN fit f ON f.entity_id = e.entity_id JOIN trusted t ON t.entity_id = e.entity_id JOIN orders ON o_orderkey = e.entity_id""",
    ("eligibility", "fit", "trusted"),
)
def h5_codes(t: Tables) -> DataFrame:
    """All three axes of every order with the codes of their reasons and unknowns."""
    made = D.decide(order_contexts(t), profiles(t), AS_OF, RULES)

    def codes(part: str, axis: str):
        return F.concat_ws(",", F.transform(F.filter(part, lambda x: x["axis"] == axis), lambda x: x["code"]))

    return made.select(
        "entity_id", "eligibility", codes("unknowns", "eligibility").alias("eligibility_unknowns"),
        "evidence_fit", codes("reasons", "evidence_fit").alias("fit_reasons"),
        "trust", codes("reasons", "trust").alias("trust_reasons"), codes("unknowns", "trust").alias("trust_unknowns"),
    )


def part_contexts(t: Tables) -> DataFrame:
    """Decision contexts of the parts from claims, checks and lineage."""
    claims = C.resolve_claims(view_rows(t))
    values = C.fresh_values(claims, W.LINES_AS_OF, W.LINES_MAX_AGE)
    rules = R.DecisionRules(max_age_days=W.LINES_MAX_AGE)
    lines = E.lineage(W.entities(t), W.origins(t), W.raw(t), W.batches(t), W.sources(t))
    notes = t.lineitem.select(W.line_id().alias("raw_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("notes"))
    effective = V.effective_attempt(W.attempts(t), W.entities(t), W.orgs(t))
    return D.build_context(W.entities(t), W.orgs(t), values, effective, lines, notes, W.LINES_AS_OF, rules)


def view_rows(t: Tables) -> C.RowClaims:
    """Order lines that make view_claims."""
    field = F.col("field")
    named = F.when(field == "returnflag", "recruitment_type").when(field == "linestatus", "title").otherwise("deadline")
    return W.line_rows(t).then(lambda claims: claims.withColumn("field", named).withColumn("applicable", F.lit(True)))


def view_claims(t: Tables) -> DataFrame:
    """Order line claims under the names the views know."""
    return view_rows(t).made()


shared(
    "view_claims",
    """SELECT * REPLACE (CASE field WHEN 'returnflag' THEN 'recruitment_type' WHEN 'linestatus' THEN 'title' ELSE 'deadline' END AS field) FROM labelled""",
    "labelled",
)
shared(
    "fresh",
    f"""SELECT entity_id, field, coalesce(max(CASE WHEN reason = 'selected' THEN value_key END),
         CASE WHEN count(DISTINCT value_key) FILTER (WHERE authority = top) = 1 THEN max(value_key) FILTER (WHERE authority = top) END) AS value_key,
         bool_or(reason = 'conflict') AS in_conflict, max(observed_at) AS seen_at
       FROM (SELECT *, max(authority) OVER (PARTITION BY entity_id, field) AS top FROM view_claims
             WHERE value_key <> '' AND observed_at >= TIMESTAMP '{W.LINES_AS_OF}' - to_days({int(W.LINES_MAX_AGE)})) GROUP BY 1, 2""",
    "view_claims",
)
shared(
    "contexts",
    f"""SELECT e.entity_id, e.kind, CASE WHEN e.kind = 'CAMPAIGN' THEN '产品经理' ELSE coalesce(f.title, '') END AS title,
       coalesce(f.recruitment_type, '') AS recruitment_type, coalesce(v.result, 'UNKNOWN') AS verification_result,
       coalesce(l.sources, 0) AS source_count, greatest(f.seen_at, l.seen_at) AS latest_source_at, coalesce(f.conflicts, '') AS conflicts, coalesce(n.notes, '') AS notes
       FROM entities e LEFT JOIN (SELECT entity_id, max(CASE WHEN field = 'title' THEN value_key END) AS title, max(CASE WHEN field = 'recruitment_type' THEN value_key END) AS recruitment_type,
           max(seen_at) AS seen_at, string_agg(CASE WHEN in_conflict THEN field END, ',' ORDER BY field) AS conflicts FROM fresh GROUP BY 1) f ON f.entity_id = e.entity_id
       LEFT JOIN effective v ON v.entity_id = e.entity_id
       LEFT JOIN (SELECT entity_id, max(CASE WHEN raw_kind = kind THEN seen_at END) AS seen_at,
           count(DISTINCT independence_group) FILTER (WHERE raw_kind = kind AND seen_at >= TIMESTAMP '{W.LINES_AS_OF}' - to_days({int(W.LINES_MAX_AGE)})) AS sources
         FROM lineage GROUP BY 1) l ON l.entity_id = e.entity_id
       LEFT JOIN (SELECT r.entity_id, arg_max(l_linestatus, struct_pack(c := r.created_at, i := r.raw_id)) AS notes FROM lineage r
         JOIN lineitem ON {W.LINE_ID} = r.raw_id WHERE r.raw_kind = r.kind GROUP BY 1) n ON n.entity_id = e.entity_id""",
    "entities", "fresh", "effective", "lineage",
)


@query(
    "h1_build_context",
    "SELECT entity_id, kind, title, recruitment_type, verification_result, source_count, latest_source_at, conflicts, notes FROM contexts",
    ("contexts",),
)
def h1(t: Tables) -> DataFrame:
    """Everything a decision looks at, one line per part."""
    return part_contexts(t).select(
        "entity_id", "kind", "title", "recruitment_type", "verification_result", "source_count", "latest_source_at",
        F.concat_ws(",", "conflicting_fields").alias("conflicts"), F.col("jd_text").alias("notes"),
    )


def recomputed(t: Tables) -> DataFrame:
    """A stand-in recomputation: trust by type and fingerprint by size of the part."""
    return t.part.select(
        F.col("p_partkey").alias("entity_id"),
        F.when(F.col("p_type").isin("SMALL", "LARGE", "PROMO"), "VERIFIED").otherwise("CONSISTENT").alias("trust"),
        F.when(F.col("p_size") < 25, "1-URGENT").otherwise("2-HIGH").alias("fingerprint"),
        F.lit("PASS").alias("eligibility"),
        F.lit("APPLY").alias("evidence_fit"),
        F.lit("2002-01-01").cast("timestamp").alias("created_at"),
    )


shared(
    "recomputed",
    """SELECT p_partkey AS entity_id, CASE WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 'VERIFIED' ELSE 'CONSISTENT' END AS trust,
       CASE WHEN p_size < 25 THEN '1-URGENT' ELSE '2-HIGH' END AS fingerprint FROM part""",
)
shared(
    "valid_current",
    "SELECT c.* FROM current c JOIN recomputed r ON r.entity_id = c.entity_id WHERE r.trust = c.trust AND r.fingerprint = c.fingerprint",
    "current", "recomputed",
)


@query(
    "h6_store_decisions",
    """SELECT d.decision_id, d.entity_id, d.is_current AND p.p_partkey IS NULL AS is_current, d.manual FROM decisions d LEFT JOIN part p ON p.p_partkey = d.entity_id
       UNION ALL SELECT p_partkey || ':2002-01-01 00:00:00', p_partkey, TRUE, coalesce(m.manual, 'UNDECIDED') FROM part
       LEFT JOIN (SELECT entity_id, arg_max(manual, struct_pack(c := created_at, i := decision_id)) AS manual FROM decisions GROUP BY 1) m ON m.entity_id = p_partkey""",
    ("decisions",),
)
def h6(t: Tables) -> DataFrame:
    """History with a new decision for every part; manual verdicts carry over."""
    stored = D.store_decisions(W.decisions(t), recomputed(t))
    return stored.select("decision_id", "entity_id", "is_current", "manual")


@query(
    "h7_invalidate",
    """SELECT decision_id, is_current AND NOT coalesce(p_size < 25, FALSE) AS is_current FROM decisions LEFT JOIN part ON p_partkey = entity_id""",
    ("decisions",),
)
def h7(t: Tables) -> DataFrame:
    """Decisions of small parts are stale."""
    small = t.part.filter("p_size < 25").select(F.col("p_partkey").alias("entity_id"))
    return D.invalidate(W.decisions(t), small).select("decision_id", "is_current")


@query(
    "h8_reconcile_stale",
    """SELECT d.decision_id, d.is_current AND coalesce(r.trust = d.trust AND r.fingerprint = d.fingerprint, FALSE) AS is_current
       FROM decisions d LEFT JOIN recomputed r ON r.entity_id = d.entity_id""",
    ("decisions", "recomputed"),
)
def h8(t: Tables) -> DataFrame:
    """Current marks that a recomputation no longer supports are switched off."""
    return D.reconcile_stale(W.decisions(t), recomputed(t)).select("decision_id", "is_current")


@query(
    "h9_recompute",
    """SELECT o.o_orderkey AS entity_id, t.trust, e.eligibility, f.evidence_fit FROM orders o JOIN eligibility e ON e.entity_id = o.o_orderkey
       JOIN fit f ON f.entity_id = o.o_orderkey JOIN trusted t ON t.entity_id = o.o_orderkey WHERE o.o_totalprice > 250000""",
    ("eligibility", "fit", "trusted"),
)
def h9(t: Tables) -> DataFrame:
    """Decisions of large orders computed again; older lines stay in the history."""
    past = order_contexts(t).select(
        "entity_id", F.col("entity_id").cast("string").alias("decision_id"), F.lit("UNKNOWN").alias("eligibility"),
        F.lit("UNKNOWN").alias("evidence_fit"), F.lit("UNKNOWN").alias("trust"), F.lit("").alias("fingerprint"),
        F.lit(True).alias("is_current"), F.lit("HOLD").alias("manual"), F.lit("r").alias("override_reason"),
        F.col("latest_source_at").alias("created_at"),
    )
    keys = t.orders.filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("entity_id"))
    stored = D.recompute(order_contexts(t), profiles(t), past, AS_OF, keys, RULES)
    new = stored.filter("is_current and fingerprint <> '' and manual = 'HOLD'")
    return new.select("entity_id", "trust", "eligibility", "evidence_fit")


@query(
    "h10_override_decisions",
    """SELECT c.entity_id, coalesce(u.manual, c.manual) AS manual, coalesce(u.reason, '') AS override_reason FROM current c
       LEFT JOIN (SELECT user_id AS entity_id, arg_max(CASE event_type WHEN 'click' THEN 'HOLD' WHEN 'signup' THEN 'REJECT' ELSE 'UNDECIDED' END, struct_pack(t := ts)) AS manual,
         arg_max(CASE WHEN event_type IN ('click', 'signup') THEN event_type ELSE '' END, struct_pack(t := ts)) AS reason
         FROM events WHERE event_type <> 'error' GROUP BY 1) u ON u.entity_id = c.entity_id""",
    ("current",),
)
def h10(t: Tables) -> DataFrame:
    """Current decisions after manual verdicts; those without a reason are refused."""
    kind = F.col("event_type")
    commands = t.events.select(
        F.col("user_id").alias("entity_id"),
        F.when(kind.isin("click", "error"), "HOLD").when(kind == "signup", "REJECT").otherwise("UNDECIDED").alias("manual"),
        F.when(kind.isin("click", "signup"), kind).otherwise("").alias("reason"),
        F.col("ts").alias("at"),
    )
    history, _ = D.override_decisions(W.decisions(t), commands)
    return D.current_decisions(history).select("entity_id", "manual", "override_reason")


@query("h11_current_decisions", "SELECT entity_id, decision_id, trust, created_at FROM current", ("current",))
def h11(t: Tables) -> DataFrame:
    """The newest current decision per part."""
    return D.current_decisions(W.decisions(t)).select("entity_id", "decision_id", "trust", "created_at")


@query(
    "h11_keep_newest_current",
    """SELECT d.decision_id, c.decision_id IS NOT NULL AS is_current FROM decisions d LEFT JOIN current c ON c.decision_id = d.decision_id""",
    ("decisions", "current"),
)
def h11_repair(t: Tables) -> DataFrame:
    """History with at most one current line per part."""
    return D.keep_newest_current(W.decisions(t)).select("decision_id", "is_current")
