"""Lists, queues, shortlist and dashboard."""

from __future__ import annotations

import dataclasses
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import claims as C, decisions as D, entities as E, serving as S, verification as V
from accordant.operators.paging import By, after, write_order
from accordant.operators.search_index import build_index
from accordant.plans import workspace as W
from accordant.plans.q_decisions import recomputed, view_rows
from accordant.plans.q_entities import pair_entities, reviewed_pairs, scored_neighbours
from accordant.plans.q_snapshots import yearly_diff
from accordant.plans.registry import Tables, query, shared
from accordant.plans.stored import state_of, stored_view, working_view, write_state
from accordant.sources.sinks import csv_rows, export_rows, markdown_sections

AGE = dataclasses.replace(R.DecisionRules(), max_age_days=W.EVENTS_MAX_AGE)


def view(t: Tables) -> DataFrame:
    """The view over the source tables, without any stored state."""
    claims = C.resolve_claims(view_rows(t))
    counts = E.lineage_counts(E.lineage(W.entities(t), W.origins(t), W.raw(t), W.batches(t), W.sources(t)))
    effective = V.effective_attempt(W.attempts(t), W.entities(t), W.orgs(t))
    history = D.still_current(W.decisions(t), recomputed(t))
    return S.entity_view(W.entities(t), W.orgs(t), claims, counts, effective, history)


def served(t: Tables) -> DataFrame:
    return stored_view(state_of(t))


def slim_view(t: Tables) -> DataFrame:
    """The columns the list filters need, without the rest of the view."""
    picked = S.selected_values(C.resolve_claims(view_rows(t)))
    return (
        W.entities(t)
        .join(W.orgs(t).select("org_id", "canonical_name"), "org_id")
        .join(picked, "entity_id", "left")
        .withColumnsRenamed({"title": "display_title"})
    )


shared(
    "picked",
    """SELECT entity_id, max(CASE WHEN field = 'title' AND reason = 'selected' THEN value_key END) AS sel_title,
       max(CASE WHEN field = 'recruitment_type' AND reason = 'selected' THEN value_key END) AS sel_type,
       bool_or(reason = 'conflict') AS has_conflict FROM view_claims GROUP BY 1""",
    "view_claims",
)
shared(
    "shown_values",
    """SELECT entity_id, max(CASE WHEN field = 'linestatus' AND NOT (chosen IS NULL AND torn) THEN coalesce(chosen, best) END) AS title,
       max(CASE WHEN field = 'returnflag' AND NOT (chosen IS NULL AND torn) THEN coalesce(chosen, best) END) AS recruitment_type,
       count(*) FILTER (WHERE chosen IS NULL AND torn) AS conflict_count, count(*) FILTER (WHERE differs) AS historical_difference_count FROM display GROUP BY 1""",
    "display",
)
shared(
    "entity_view",
    """SELECT e.entity_id, e.kind, e.review_status, e.updated_at, e.org_id AS company, CASE WHEN e.kind = 'CAMPAIGN' THEN '产品经理' ELSE coalesce(s.title, '') END AS title,
       coalesce(e.official_job_id, '') AS official_job_id, coalesce(s.recruitment_type, '') AS recruitment_type, coalesce(l.source_count, 0) AS source_count,
       coalesce(l.observation_count, 0) AS observation_count, coalesce(s.conflict_count, 0) AS conflict_count,
       coalesce(s.historical_difference_count, 0) AS historical_difference_count, f.result AS verification, f.checked_at AS verified_at,
       c.eligibility, c.evidence_fit, c.trust, c.entity_id IS NOT NULL AS decision_current, h.entity_id IS NOT NULL AND c.entity_id IS NULL AS needs_recompute,
       h.entity_id IS NOT NULL AS has_history, coalesce(c.manual, 'UNDECIDED') AS manual, coalesce(p.has_conflict, FALSE) AS has_conflict
       FROM entities e LEFT JOIN shown_values s ON s.entity_id = e.entity_id LEFT JOIN lineage_counts l ON l.entity_id = e.entity_id
       LEFT JOIN effective f ON f.entity_id = e.entity_id LEFT JOIN valid_current c ON c.entity_id = e.entity_id
       LEFT JOIN (SELECT DISTINCT entity_id FROM decisions) h ON h.entity_id = e.entity_id LEFT JOIN picked p ON p.entity_id = e.entity_id""",
    "entities", "shown_values", "lineage_counts", "effective", "valid_current", "decisions", "picked",
)
VIEW = (
    "entity_id", "kind", "review_status", "updated_at", "company", "title", "official_job_id", "recruitment_type", "source_count",
    "observation_count", "conflict_count", "historical_difference_count", "verification", "eligibility", "evidence_fit", "trust",
    "decision_current", "needs_recompute", "manual", "has_conflict",
)


@query("i6_entity_view", f"SELECT {', '.join(VIEW)} FROM entity_view", ("entity_view",))
def i6(t: Tables) -> DataFrame:
    """One wide line per part, from stored state."""
    return served(t).select(*VIEW)


@query("i6_view_from_sources", f"SELECT {', '.join(VIEW)} FROM entity_view", ("entity_view",))
def i6_unstored(t: Tables) -> DataFrame:
    """The same lines worked out from the source tables."""
    return view(t).select(*VIEW)


@query(
    "i6_state_load",
    """SELECT 'claims' AS part, count(DISTINCT (entity_id, field, source_key)) AS lines FROM view_claims UNION ALL SELECT 'entities', count(*) FROM entities
       UNION ALL SELECT 'lineage', count(*) FROM lineage_counts UNION ALL SELECT 'checks', count(DISTINCT entity_id) FROM scoped
       UNION ALL SELECT 'verdicts', count(DISTINCT entity_id) FROM decisions UNION ALL SELECT 'marks', count(DISTINCT entity_id) FROM decisions WHERE is_current
       UNION ALL SELECT 'shortlist', count(*) FROM shortlist""",
    ("view_claims", "entities", "lineage_counts", "scoped", "decisions", "shortlist"),
)
def i6_load(t: Tables) -> DataFrame:
    """The whole state written afresh, with the lines of each table: what an import does before anything is served."""
    state = write_state(t)
    out = None
    for part in ("claims", "entities", "lineage", "checks", "verdicts", "marks", "shortlist"):
        lines = state.read(part).agg(F.lit(part).alias("part"), F.count("*").alias("lines"))
        out = lines if out is None else out.unionByName(lines)
    return out


@query(
    "i1_filter_entities",
    """SELECT e.entity_id FROM entities e JOIN picked p ON p.entity_id = e.entity_id
       WHERE e.review_status <> 'MERGED' AND (lower(e.title) LIKE '%red%' OR lower(e.org_id) LIKE '%red%' OR lower(p.sel_title) LIKE '%red%') AND e.kind = 'POSTING'""",
    ("entities", "picked"),
)
def i1(t: Tables) -> DataFrame:
    """Live postings that match a search."""
    return S.filter_entities(slim_view(t), search=" RED ", kind="POSTING").select("entity_id")


@query(
    "i1_filter_by_claim",
    """SELECT e.entity_id FROM entities e JOIN picked p ON p.entity_id = e.entity_id
       WHERE e.review_status = 'PENDING' AND lower(p.sel_type) LIKE '%a%' AND p.has_conflict""",
    ("entities", "picked"),
)
def i1_claim(t: Tables) -> DataFrame:
    """Pending entities in conflict whose selected type matches a token."""
    return S.filter_entities(
        slim_view(t), review_status="PENDING", recruitment_type="a", conflict_only=True
    ).select("entity_id")


@query(
    "i2_deadline_window",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-05-30'""",
)
def i2(t: Tables) -> DataFrame:
    """Orders due within ninety days; free text is never due."""
    written = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "招满为止").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sel_deadline"),
        F.lit("PENDING").alias("review_status"),
    )
    return S.filter_entities(written, "1998-03-01 15:00:00", deadline_days=90).select("o_orderkey")


def scoped(t: Tables, check_path: bool = True) -> DataFrame:
    return V.in_scope_attempts(W.attempts(t), W.entities(t), W.orgs(t), check_path)


def fresh(t: Tables) -> DataFrame:
    return V.fresh_open(scoped(t), W.EVENTS_AS_OF, W.EVENTS_MAX_AGE)


shared(
    "fresh_checks",
    """SELECT entity_id, bool_or(checked_at >= TIMESTAMP '2024-01-30 12:00:00') AS has_fresh,
       bool_or(checked_at >= TIMESTAMP '2024-01-30 12:00:00' AND result = 'OPEN') AS has_fresh_open FROM scoped GROUP BY 1""",
    "scoped",
)
shared(
    "listed",
    """SELECT * EXCLUDE rn FROM (SELECT d.*, row_number() OVER (PARTITION BY d.entity_id ORDER BY created_at DESC, decision_id DESC) AS rn FROM decisions d
       LEFT JOIN fresh_checks f ON f.entity_id = d.entity_id WHERE is_current AND (trust NOT IN ('VERIFIED', 'VERIFIED_WITH_CONFLICT') OR coalesce(has_fresh, FALSE))) WHERE rn = 1""",
    "decisions", "fresh_checks",
)


@query(
    "i3_filter_by_decision",
    "SELECT e.entity_id FROM entities e JOIN listed l ON l.entity_id = e.entity_id WHERE l.eligibility = 'PASS' AND l.manual = 'UNDECIDED'",
    ("entities", "listed"),
)
def i3(t: Tables) -> DataFrame:
    """Parts whose listed decision passes and is undecided by hand."""
    return S.filter_by_decision(W.entities(t), W.decisions(t), fresh(t), eligibility="PASS", manual="UNDECIDED").select("entity_id")


@query(
    "i4_filter_by_verification",
    """SELECT entity_id FROM (SELECT entity_id, result, row_number() OVER (PARTITION BY entity_id ORDER BY checked_at DESC, created_at DESC, verification_id DESC) AS rn FROM scoped)
       WHERE rn = 1 AND result = 'OPEN'""",
    ("scoped",),
)
def i4(t: Tables) -> DataFrame:
    """Parts whose latest check in domain scope found them open."""
    return S.filter_by_verification(W.entities(t), V.latest_attempt(scoped(t, check_path=False)), "OPEN").select("entity_id")


@query(
    "i5_paginate",
    "SELECT entity_id, updated_at FROM entities WHERE review_status <> 'MERGED' ORDER BY updated_at DESC, entity_id LIMIT 30 OFFSET 60",
    ("entities",),
)
def i5(t: Tables) -> DataFrame:
    """The third page of thirty live entities, newest first."""
    live = W.entities(t).filter("review_status <> 'MERGED'")
    return S.paginate(live, S.sort_keys("updated"), 3, 30)[0].select("entity_id", "updated_at")


NEWEST = (By("updated_at", descending=True), By("entity_id"))
LIST_COLUMNS = "entity_id, kind, company, title, recruitment_type, source_count, conflict_count, verification, eligibility, trust, decision_current, has_conflict"


@query(
    "i5_list_page",
    f"""SELECT row_number() OVER (ORDER BY updated_at DESC, entity_id) AS rank, {LIST_COLUMNS} FROM entity_view
        WHERE review_status <> 'MERGED' ORDER BY updated_at DESC, entity_id LIMIT 30""",
    ("entity_view",),
)
def i5_list(t: Tables) -> DataFrame:
    """The first page of the list with all that the view shows: thirty ids in order, then only their lines."""
    state = state_of(t)
    live = state.read("entities").filter("review_status <> 'MERGED'")
    # A page of ids goes through the driver; it is as long as the page.
    first = live.orderBy(*[by.order for by in NEWEST]).limit(30).select("entity_id").collect()
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(first, 1) for x in (r[0], k)]) if first else F.create_map()
    page = stored_view(state, ids=[r[0] for r in first])
    return page.select(rank[F.col("entity_id")].cast("long").alias("rank"), *LIST_COLUMNS.split(", "))


@query(
    "i5_page_by_rank",
    """SELECT rank, entity_id, updated_at FROM (SELECT row_number() OVER (ORDER BY updated_at DESC, entity_id) AS rank, * FROM entities WHERE review_status <> 'MERGED')
       WHERE rank BETWEEN 1501 AND 1530""",
    ("entities",),
)
def i5_ranked(t: Tables) -> DataFrame:
    """Page 51 of thirty live entities, read from the one or two stored ranges that hold it."""
    live = W.entities(t).filter("review_status <> 'MERGED'")
    return write_order(live, NEWEST).page(51, 30).select("rank", "entity_id", "updated_at")


@query(
    "i5_seek",
    """SELECT entity_id, updated_at FROM entities WHERE review_status <> 'MERGED' AND (updated_at < TIMESTAMP '1998-01-21' OR (updated_at = TIMESTAMP '1998-01-21' AND entity_id > 100))
       ORDER BY updated_at DESC, entity_id LIMIT 30""",
    ("entities",),
)
def i5_seek(t: Tables) -> DataFrame:
    """The thirty live entities behind the last one shown."""
    live = W.entities(t).filter("review_status <> 'MERGED'")
    return after(live, NEWEST, (datetime(1998, 1, 21), 100), 30).select("entity_id", "updated_at")


@query("i5_total", "SELECT count(*) AS total FROM entities WHERE review_status <> 'MERGED'", ("entities",))
def i5_total(t: Tables) -> DataFrame:
    """How many live entities there are to page through."""
    return S.paginate(W.entities(t).filter("review_status <> 'MERGED'"), S.sort_keys("updated"), 1, 30)[1]


@query(
    "i5_sort_by_deadline",
    """SELECT o_orderkey AS entity_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'open' END AS deadline FROM orders
       ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50""",
)
def i5_deadline(t: Tables) -> DataFrame:
    """The second page of fifty orders by deadline, undated ones last."""
    rows = t.orders.select(
        F.col("o_orderkey").alias("entity_id"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("open").alias("deadline"),
    )
    return S.paginate(rows, S.sort_keys("deadline"), 2, 50)[0]


@query(
    "i7_entity_detail",
    """SELECT entity_id, 'claim' AS section, count(*) AS items FROM claims WHERE entity_id IN (SELECT user_id FROM events) GROUP BY 1
       UNION ALL SELECT entity_id, 'origin', count(*) FROM raw WHERE entity_id IN (SELECT user_id FROM events) GROUP BY 1
       UNION ALL SELECT entity_id, 'verification', count(*) FROM attempts GROUP BY 1
       UNION ALL SELECT entity_id, 'decision', count(*) FROM decisions WHERE entity_id IN (SELECT user_id FROM events) GROUP BY 1
       UNION ALL SELECT l_partkey, 'linked_posting', count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey IN (SELECT user_id FROM events) GROUP BY 1
       UNION ALL SELECT l_suppkey, 'linked_campaign', count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey IN (SELECT user_id FROM events) GROUP BY 1""",
    ("claims", "raw", "attempts", "decisions"),
)
def i7(t: Tables) -> DataFrame:
    """Items behind every part that was ever checked, by section."""
    ids = t.events.select(F.col("user_id").alias("entity_id")).distinct()
    matrix = C.claim_matrix(C.resolve_claims(W.line_rows(t)).withColumn("applicable", F.lit(True)))
    links = t.lineitem.select(F.col("l_partkey").alias("campaign_id"), F.col("l_suppkey").alias("posting_id")).distinct()
    detail = S.entity_detail(ids, matrix, W.origins(t), W.attempts(t), W.decisions(t), links)
    return detail.filter("item is not null").groupBy("entity_id", "section").agg(F.count("*").alias("items"))


def flags(t: Tables) -> DataFrame:
    conflicts = C.verdicts(W.line_rows(t)).filter("state = 'conflict'").select("entity_id")
    return S.queue_flags(W.entities(t), conflicts, W.decisions(t), fresh(t))


shared(
    "flags",
    """SELECT e.*, e.review_status <> 'MERGED' AND e.kind = 'POSTING' AND coalesce(d.ready, FALSE) AND coalesce(f.has_fresh_open, FALSE) AS ready,
       e.review_status <> 'MERGED' AND (e.kind = 'CAMPAIGN' OR coalesce(p.has_conflict, FALSE) OR d.entity_id IS NULL OR d.doubt
         OR (e.kind = 'POSTING' AND NOT coalesce(f.has_fresh_open, FALSE))) AS verify_first, coalesce(d.fits, FALSE) AS fits, coalesce(d.eligible, FALSE) AS eligible
       FROM entities e LEFT JOIN picked p ON p.entity_id = e.entity_id LEFT JOIN fresh_checks f ON f.entity_id = e.entity_id
       LEFT JOIN (SELECT entity_id, bool_or(eligibility = 'PASS' AND trust IN ('VERIFIED', 'VERIFIED_WITH_CONFLICT') AND manual NOT IN ('HOLD', 'REJECT')) AS ready,
         bool_or(manual = 'VERIFY_FIRST' OR trust IN ('UNKNOWN', 'CONFLICTED', 'STALE')) AS doubt, bool_or(evidence_fit IN ('PRIMARY', 'APPLY')) AS fits,
         bool_or(eligibility IN ('PASS', 'UNKNOWN')) AS eligible FROM decisions WHERE is_current GROUP BY 1) d ON d.entity_id = e.entity_id""",
    "entities", "picked", "fresh_checks", "decisions",
)


@query("i8_queue_flags", "SELECT entity_id, ready, verify_first, fits, eligible FROM flags", ("flags",))
def i8(t: Tables) -> DataFrame:
    """Which parts are ready and which to verify first."""
    return flags(t).select("entity_id", "ready", "verify_first", "fits", "eligible")


@query(
    "i9_ranked_queue",
    """SELECT entity_id FROM flags WHERE verify_first ORDER BY NOT eligible, NOT (lower(title) LIKE '%red%' OR lower(title) LIKE '%ring%'), NOT fits,
       kind <> 'POSTING', updated_at DESC, entity_id LIMIT 40 OFFSET 40""",
    ("flags",),
)
def i9(t: Tables) -> DataFrame:
    """The second page of the queue, wanted titles first."""
    page, _ = S.ranked_queue(flags(t), "verify_first", 2, 40, keywords=("Red", "ring"))
    return page.select("entity_id")


@query(
    "i9_queue_by_rank",
    """SELECT entity_id, rank FROM (SELECT *, row_number() OVER (ORDER BY NOT eligible, NOT (lower(title) LIKE '%red%' OR lower(title) LIKE '%ring%'), NOT fits,
         kind <> 'POSTING', updated_at DESC, entity_id) AS rank FROM flags WHERE verify_first) WHERE rank BETWEEN 401 AND 440""",
    ("flags",),
)
def i9_ranked(t: Tables) -> DataFrame:
    """Page 11 of the queue from its stored order."""
    first = {"_eligible": ~F.col("eligible"), "_wanted": ~S.has_any(F.lower("title"), ["red", "ring"]), "_fits": ~F.col("fits"), "_posting": F.col("kind") != "POSTING"}
    queue = flags(t).filter("verify_first").withColumns(first)
    order = write_order(queue.select("entity_id", "updated_at", *first), [*[By(c) for c in first], *NEWEST])
    return order.page(11, 40).select("entity_id", "rank")


@query(
    "i10_dashboard",
    """SELECT count(*) AS opportunity_count, count(*) FILTER (WHERE kind = 'POSTING') AS posting_count, count(*) FILTER (WHERE kind = 'CAMPAIGN') AS campaign_count,
       count(*) FILTER (WHERE listed) AS shortlist_total_count, count(*) FILTER (WHERE listed AND gate) AS shortlist_ready_count, count(*) FILTER (WHERE ready) AS ready_count,
       count(*) FILTER (WHERE verify_first) AS verify_first_count, count(*) FILTER (WHERE has_conflict) AS unresolved_conflict_count,
       (SELECT max(imported_at) FROM batches) AS latest_import_at, (SELECT count(DISTINCT independence_group) FROM sources) AS independent_source_count
       FROM (SELECT f.*, p.has_conflict, s.entity_id IS NOT NULL AS listed, coalesce(b.blockers = '', FALSE) AS gate FROM flags f LEFT JOIN picked p ON p.entity_id = f.entity_id
         LEFT JOIN shortlist s ON s.entity_id = f.entity_id LEFT JOIN blockers b ON b.entity_id = f.entity_id)""",
    ("flags", "picked", "batches", "sources", "shortlist", "blockers"),
)
def i10(t: Tables) -> DataFrame:
    """Ten counters in one line; a listed entry is ready if nothing blocks it."""
    state = state_of(t)
    lines = S.readiness(working_view(state), W.EVENTS_AS_OF, AGE).withColumns({"ready_now": F.col("ready"), "shortlist_ready": F.col("is_ready")})
    totals = S.count_entities(lines, state.read("shortlist"))
    return S.side_by_side(totals, *S.import_totals(state.read("batches"), state.read("sources")))


@query(
    "i11_top_pairs",
    """SELECT left_id, right_id, round(score, 6) AS score, left_title, right_title FROM (
         SELECT n.left_id, n.right_id, x.p_name AS left_title, y.p_name AS right_title, n.p_size > 45 AND y.p_size > 45 AS clash,
           CASE WHEN x.p_size = y.p_size THEN greatest(t.ratio * 0.55 + 0.45, 0.99) ELSE t.ratio * 0.55 + 0.25 END AS score
         FROM neighbours n JOIN part x ON x.p_partkey = n.left_id JOIN part y ON y.p_partkey = n.right_id
         JOIN title_ratio t ON t.a = least(replace(lower(x.p_name), ' ', ''), replace(lower(y.p_name), ' ', '')) AND t.b = greatest(replace(lower(x.p_name), ' ', ''), replace(lower(y.p_name), ' ', '')))
       WHERE NOT clash ORDER BY round(score, 6) DESC, left_id, right_id LIMIT 50""",
    ("neighbours", "title_ratio"),
)
def i11(t: Tables) -> DataFrame:
    """The fifty best pairs with both sides."""
    scored = scored_neighbours(t).withColumn("score", F.round("score", 6))
    sides = pair_entities(t).withColumn("review_status", F.lit("PENDING"))
    return S.top_pairs(scored, sides, k=50).select("left_id", "right_id", "score", "left_title", "right_title")


@query(
    "i11_top_candidates",
    """SELECT left_id, right_id, CAST(r.score AS DOUBLE) AS score, 'POSTING' AS left_kind, x.p_name AS left_title, CASE WHEN x.p_size > 45 THEN 'J-' || x.p_partkey END AS left_official_job_id,
         'POSTING' AS right_kind, y.p_name AS right_title, CASE WHEN y.p_size > 45 THEN 'J-' || y.p_partkey END AS right_official_job_id
       FROM (SELECT * FROM reviewed WHERE decision = 'REVIEW' ORDER BY score DESC, left_id, right_id LIMIT 50) r
       JOIN part x ON x.p_partkey = r.left_id JOIN part y ON y.p_partkey = r.right_id""",
    ("reviewed",),
)
def i11_candidates(t: Tables) -> DataFrame:
    """The fifty best candidates still open after upsert and review, with a brief of both sides."""
    sides = pair_entities(t).withColumn("review_status", F.lit("PENDING"))
    return S.top_pairs(reviewed_pairs(t), sides, k=50).select(
        "left_id", "right_id", "score", *[f"{s}_{c}" for s in ("left", "right") for c in ("kind", "title", "official_job_id")]
    )


@query(
    "i12_source_summary",
    """SELECT s.source_id, count(b.batch_id) AS batch_count, coalesce(sum(b.row_count), 0)::BIGINT AS raw_count, max(b.imported_at) AS latest_import_at
       FROM sources s LEFT JOIN batches b ON b.source_id = s.source_id GROUP BY 1""",
    ("sources", "batches"),
)
def i12(t: Tables) -> DataFrame:
    """Batches, rows and latest import per supplier."""
    summary = S.source_summary(W.sources(t), W.batches(t).drop("row_count"), W.raw(t))
    return summary.select("source_id", "batch_count", "raw_count", "latest_import_at")


@query(
    "i13_list_runs",
    "SELECT batch_id AS run_id, snapshot_at AS started_at FROM batches ORDER BY snapshot_at DESC, batch_id DESC LIMIT 20",
    ("batches",),
)
def i13(t: Tables) -> DataFrame:
    """The twenty latest runs."""
    runs = W.batches(t).select(F.col("batch_id").alias("run_id"), F.col("snapshot_at").alias("started_at"))
    return S.list_runs(runs, 20)


@query(
    "i13_list_changes",
    "SELECT change, custkey || '-' || year AS source_record_id FROM diff WHERE change = 'MODIFIED' ORDER BY change, source_record_id LIMIT 100 OFFSET 100",
    ("diff",),
)
def i13_changes(t: Tables) -> DataFrame:
    """The second page of modified records."""
    changes = yearly_diff(t).select("change", F.col("record").alias("source_record_id"))
    return S.list_changes(changes, "MODIFIED", 2, 100)


@query(
    "i13_changes_by_rank",
    """SELECT rank, change, source_record_id FROM (SELECT row_number() OVER (ORDER BY change, source_record_id) AS rank, * FROM (
         SELECT change, custkey || '-' || year AS source_record_id FROM diff)) WHERE rank BETWEEN 1001 AND 1100""",
    ("diff",),
)
def i13_ranked(t: Tables) -> DataFrame:
    """Page 11 of all changes from their stored order."""
    changes = yearly_diff(t).select("change", F.col("record").alias("source_record_id"))
    return write_order(changes, [By("change"), By("source_record_id")]).page(11, 100)


shared(
    "blockers",
    """SELECT *, concat_ws(',', CASE WHEN kind <> 'POSTING' THEN 'not_a_posting' END, CASE WHEN review_status = 'MERGED' THEN 'merged' END,
         CASE WHEN kind = 'POSTING' AND official_job_id = '' THEN 'posting_id_missing' END, CASE WHEN title = '' THEN 'title_missing' END,
         CASE WHEN NOT decision_current AND has_history THEN 'decision_stale' END, CASE WHEN NOT decision_current AND NOT has_history THEN 'decision_missing' END,
         CASE WHEN decision_current AND eligibility <> 'PASS' THEN 'not_eligible' END, CASE WHEN decision_current AND trust NOT IN ('VERIFIED', 'VERIFIED_WITH_CONFLICT') THEN 'not_verified' END,
         CASE WHEN decision_current AND manual IN ('HOLD', 'REJECT') THEN 'parked' END, CASE WHEN coalesce(verification, '') <> 'OPEN' THEN 'not_open' END,
         CASE WHEN verification = 'OPEN' AND verified_at < TIMESTAMP '2024-01-30 12:00:00' THEN 'check_too_old' END) AS blockers FROM entity_view""",
    "entity_view",
)


@query("i14_readiness", "SELECT entity_id, blockers, blockers = '' AS is_ready FROM blockers", ("blockers",))
def i14(t: Tables) -> DataFrame:
    """What keeps each part from the shortlist."""
    ready = S.readiness(served(t), W.EVENTS_AS_OF, AGE)
    return ready.select("entity_id", F.concat_ws(",", "blockers").alias("blockers"), "is_ready")


@query(
    "i15_shortlist_view",
    "SELECT s.entity_id, s.priority, s.added_at, s.stage AS application_stage, b.blockers = '' AS ready, b.title FROM shortlist s JOIN blockers b ON b.entity_id = s.entity_id",
    ("shortlist", "blockers"),
)
def i15(t: Tables) -> DataFrame:
    """Shortlist entries beside their part and its readiness."""
    state = state_of(t)
    shown = S.shortlist_view(state.read("shortlist"), S.readiness(stored_view(state), W.EVENTS_AS_OF, AGE))
    return shown.select("entity_id", "priority", "added_at", "application_stage", "ready", "title")


def shortlist_commands(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.filter(kind.isin("purchase", "error", "click")).select(
        F.col("user_id").alias("entity_id"),
        F.when(kind == "purchase", "ADD").when(kind == "error", "REMOVE").otherwise("STAGE").alias("action"),
        F.lit(7).alias("priority"),
        F.lit("again").alias("note"),
        F.when(F.col("value") < 40, "APPLIED").otherwise("OFFER").alias("stage"),
        F.lit(" call ").alias("next_action"),
        F.lit(None).cast("timestamp").alias("next_action_at"),
        F.col("ts").alias("at"),
    )


def shortlist_gate(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") > 20).alias("is_ready"))


shared(
    "moves_of",
    """SELECT entity_id, action, ts, value, s.entity_id IS NOT NULL AS held,
         count(*) FILTER (WHERE action = 'REMOVE') OVER (PARTITION BY entity_id ORDER BY ts, action ROWS UNBOUNDED PRECEDING) AS period,
         last_value(CASE WHEN action = 'REMOVE' OR (action = 'ADD' AND ready) THEN action END IGNORE NULLS)
           OVER (PARTITION BY entity_id ORDER BY ts, action ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, ready
       FROM (SELECT user_id AS entity_id, CASE event_type WHEN 'purchase' THEN 'ADD' WHEN 'error' THEN 'REMOVE' ELSE 'STAGE' END AS action, ts, value,
               coalesce(p_size > 20, FALSE) AS ready
             FROM events LEFT JOIN part ON p_partkey = user_id WHERE event_type IN ('purchase', 'error', 'click')) c
       LEFT JOIN shortlist s USING (entity_id)""",
    "shortlist",
)
shared(
    "progress_of",
    """SELECT entity_id, max(period) AS period, max(CASE WHEN action = 'ADD' THEN period END) AS added,
         max(CASE WHEN action = 'STAGE' THEN period END) AS staged,
         arg_max(CASE WHEN value < 40 THEN 'APPLIED' ELSE 'OFFER' END, struct_pack(p := period, t := ts)) FILTER (WHERE action = 'STAGE') AS stage,
         arg_max(period, period) FILTER (WHERE action = 'STAGE' AND value < 40) AS applied_period,
         arg_max(ts, struct_pack(p := period, t := -epoch_us(ts))) FILTER (WHERE action = 'STAGE' AND value < 40) AS applied
       FROM moves_of WHERE (action = 'ADD' AND ready) OR action = 'REMOVE' OR (action = 'STAGE' AND (before = 'ADD' OR (before IS NULL AND held)))
       GROUP BY 1""",
    "moves_of",
)


@query(
    "i16_update_shortlist",
    """SELECT entity_id, CASE WHEN m.added = m.period THEN 7 ELSE s.priority END AS priority, CASE WHEN m.added = m.period THEN 'again' ELSE s.note END AS note,
         CASE WHEN m.staged = m.period THEN m.stage WHEN kept THEN s.stage ELSE 'TO_APPLY' END AS stage,
         CASE WHEN m.staged = m.period THEN 'call' ELSE '' END AS next_action, CASE WHEN m.applied_period = m.period THEN m.applied END AS applied_at
       FROM (SELECT entity_id, s.stage, s.priority, s.note, s.entity_id IS NOT NULL AND coalesce(m.period, 0) = 0 AS kept
             FROM shortlist s FULL JOIN progress_of m USING (entity_id)) s LEFT JOIN progress_of m USING (entity_id)
       WHERE kept OR coalesce(m.added = m.period, FALSE)""",
    ("shortlist", "progress_of"),
)
def i16(t: Tables) -> DataFrame:
    """The shortlist after additions through the gate, removals and progress."""
    out, _, _ = S.update_shortlist(W.shortlist(t), shortlist_commands(t), shortlist_gate(t))
    return out.select("entity_id", "priority", "note", "stage", "next_action", "applied_at")


@query(
    "i16_stage_histogram",
    "SELECT s.stage, count(l.entity_id) AS entries FROM (VALUES " + ", ".join(f"('{s}')" for s in R.STAGES) + ") s(stage) LEFT JOIN shortlist l ON l.stage = s.stage GROUP BY 1",
    ("shortlist",),
)
def i16_stages(t: Tables) -> DataFrame:
    """Entries per stage, empty stages too."""
    return S.stage_histogram(W.shortlist(t))


WORDS = ("red", "ring", "Brand#1", "zzz")


@query(
    "i17_keyword_totals",
    " UNION ALL ".join(
        f"SELECT '{w}' AS keyword, count(*) AS total FROM part WHERE contains(lower(p_name), '{w.lower()}') OR contains(lower(p_brand), '{w.lower()}')" for w in WORDS
    ),
)
def i17_totals(t: Tables) -> DataFrame:
    """Hits per keyword."""
    return searched(t)[1]


def searched(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = W.entities(t).withColumns({"company": F.col("org_id"), "apply_url": F.lit("")})
    return S.keyword_search(rows, WORDS, 60)


@query(
    "i17_keyword_search",
    """SELECT entity_id FROM entities WHERE contains(lower(title), 'red') OR contains(lower(title), 'ring') OR contains(lower(org_id), 'brand#1')
       ORDER BY official_job_id IS NULL, org_id, title, entity_id LIMIT 60""",
    ("entities",),
)
def i17(t: Tables) -> DataFrame:
    """The sixty best hits over all keywords, each once."""
    return searched(t)[0].select("entity_id")


INDEXED = ("red", "Ring", "#1", "brand#12", "e g", "zzz", "o")


@query(
    "i17_search_index",
    " UNION ALL ".join(
        f"SELECT '{w}' AS keyword, p_partkey AS entity_id FROM part WHERE contains(lower(p_name), '{w.lower()}') OR contains(lower(p_brand), '{w.lower()}')" for w in INDEXED
    ),
)
def i17_index(t: Tables) -> DataFrame:
    """Every hit of several keywords through the stored index, short ones by a scan."""
    index = build_index(W.entities(t), "entity_id", ("title", "org_id"))
    out = None
    for word in INDEXED:
        hits = index.search(word).select(F.lit(word).alias("keyword"), "entity_id")
        out = hits if out is None else out.unionByName(hits)
    return out


def exported(t: Tables) -> DataFrame:
    """Customers as a ready shortlist of orders' segments."""
    rows = W.shortlist(t).withColumns(
        {
            "ready": F.lit(True), "company": F.concat(F.lit("="), F.col("note")), "title": F.lit(" +t"),
            "cities": F.array(F.lit("a"), F.lit("b")), "eligibility": F.lit("PASS"), "evidence_fit": F.lit("APPLY"),
            "trust": F.lit("VERIFIED"), "verification": F.lit("OPEN"), "apply_url": F.lit("https://e.example/x"),
            "application_stage": F.col("stage"), "next_action": F.lit("-x"),
        }
    )
    return export_rows(rows)


@query(
    "a8_export_rows",
    """SELECT '''=' || note AS company, ''' +t' AS title, 'a / b' AS cities, '''-x' AS next_action, stage AS application_stage, priority, note FROM shortlist""",
    ("shortlist",),
)
def a8(t: Tables) -> DataFrame:
    """Shortlist rows as they go into a spreadsheet."""
    return csv_rows(exported(t)).select("company", "title", "cities", "next_action", "application_stage", "priority", "note")


@query(
    "a9_markdown_sections",
    """SELECT row_number() OVER (ORDER BY priority DESC, added_at, entity_id) AS position,
       CASE WHEN row_number() OVER (ORDER BY priority DESC, added_at, entity_id) = 1 THEN '# 可信投递短名单' || chr(10) || chr(10) ELSE '' END
       || '## ' || row_number() OVER (ORDER BY priority DESC, added_at, entity_id) || '. =' || note || '｜ +t' AS heading FROM shortlist""",
    ("shortlist",),
)
def a9(t: Tables) -> DataFrame:
    """Numbered sections of the Markdown export."""
    sections = markdown_sections(exported(t))
    return sections.select(F.col("position").cast("long").alias("position"), F.regexp_extract("value", "^((?:#[^\n]*\n\n)?## [^\n]*)", 1).alias("heading"))
