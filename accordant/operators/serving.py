"""Lists, queues, shortlist and dashboard over one wide entity view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import CAMPAIGN, POSTING, present_title
from accordant.functions.text import clean_text, has_any, strip_text
from accordant.functions.times import deadline_within, strict_date, within
from accordant.operators.claims import field_facts
from accordant.operators.decisions import current_decisions
from accordant.session import fact_join, first_per_group

VERIFIED = ("VERIFIED", "VERIFIED_WITH_CONFLICT")
UNSETTLED = ("UNKNOWN", "CONFLICTED", "STALE")
PARKED = ("HOLD", "REJECT")
LIST_FILTERS = {"city": "cities", "graduation_year": "graduation_years"}
TEXT_FILTERS = {"recruitment_type": "recruitment_type", "employer_type": "employer_type", "written_test": "written_test"}
VIEW_FIELDS = (
    "cities", "graduation_years", "recruitment_type", "industry", "employer_type", "written_test", "published_at",
    "deadline", "apply_url", "announcement_url",
)


SELECTED_FIELDS = (
    "company", "title", "cities", "graduation_years", "recruitment_type", "employer_type", "written_test", "deadline",
)


def _picked() -> list[Column]:
    """Aggregates over field_facts: selected values and whether the entity has conflicts."""
    return [
        *[F.max(F.when(F.col("field") == f, F.col("selected_key"))).alias(f"sel_{f}") for f in SELECTED_FIELDS],
        *[F.max(F.when(F.col("field") == f, F.col("selected_raw"))).alias(f"raw_{f}") for f in ("company", "title")],
        F.max("in_conflict").alias("has_conflict"),
    ]


def selected_values(claims: DataFrame) -> DataFrame:
    """Per entity the selected, applicable values the filters look at, and whether it has conflicts."""
    return field_facts(claims).groupBy("entity_id").agg(*_picked())


def filter_entities(
    view: DataFrame,
    as_of: str | None = None,
    search: str = "",
    kind: str | None = None,
    review_status: str | None = None,
    deadline_days: int | None = None,
    conflict_only: bool = False,
    **tokens: str,
) -> DataFrame:
    """All given criteria together. `tokens`: city, graduation_year, recruitment_type, employer_type, written_test.

    Tokens are literal and case-insensitive; list fields match element by element.
    """
    out = view
    if review_status != "MERGED":
        out = out.filter("review_status <> 'MERGED'")
    term = search.strip().lower()
    if term:
        hit = F.lit(False)
        for name in ("display_title", "canonical_name", "raw_company", "raw_title", "sel_company", "sel_title"):
            if name in view.columns:
                hit = hit | F.coalesce(F.lower(name).contains(term), F.lit(False))
        out = out.filter(hit)
    if kind:
        out = out.filter(F.col("kind") == kind)
    if review_status:
        out = out.filter(F.col("review_status") == review_status)
    for name, token in tokens.items():
        token = token.strip().lower()
        if not token:
            continue
        if name in LIST_FILTERS:
            members = F.from_json(F.nullif(F.col(f"sel_{LIST_FILTERS[name]}"), F.lit("")), "array<string>")
            out = out.filter(F.exists(members, lambda x: F.lower(x).contains(token)))
        else:
            out = out.filter(F.lower(f"sel_{TEXT_FILTERS[name]}").contains(token))
    if deadline_days:
        out = out.filter(deadline_within(F.col("sel_deadline"), as_of, deadline_days))
    if conflict_only:
        out = out.filter("has_conflict")
    return out


def listed_decisions(decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest current decision per entity that the list trusts.

    A verified decision counts only while a fresh scoped check exists. fresh: entity_id, has_fresh.
    """
    joined = fact_join(decisions.filter("is_current"), fresh.select("entity_id", "has_fresh"), ["entity_id"])
    counts = ~F.col("trust").isin(*VERIFIED) | F.coalesce("has_fresh", F.lit(False))
    return current_decisions(joined.filter(counts).drop("has_fresh"))


def filter_by_decision(
    view: DataFrame, decisions: DataFrame, fresh: DataFrame, **wanted: str
) -> DataFrame:
    """Entities whose listed decision has the wanted eligibility, trust or manual verdict."""
    listed = listed_decisions(decisions, fresh)
    for name, value in wanted.items():
        listed = listed.filter(F.col(name) == value)
    return view.join(listed.select("entity_id"), "entity_id", "left_semi")


def filter_by_verification(view: DataFrame, latest: DataFrame, result: str) -> DataFrame:
    """Entities whose latest check in domain scope has the result.

    `latest` comes from attempts matched on kind and domain only: looser than the effective check.
    """
    return view.join(latest.filter(F.col("result") == result).select("entity_id"), "entity_id", "left_semi")


def sort_keys(sort: str = "updated") -> list[Column]:
    if sort == "deadline":
        return [strict_date(F.col("deadline")).asc_nulls_last(), F.col("entity_id").asc()]
    return [F.col("updated_at").desc(), F.col("entity_id").asc()]


def side_by_side(*lines: DataFrame) -> DataFrame:
    """One line with the columns of several one-line results, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def paginate(df: DataFrame, sort: Sequence[Column], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(one page, one-line total). Only the rows up to the page's end leave the tasks."""
    return (
        df.orderBy(*sort).offset((page - 1) * size).limit(size),
        df.agg(F.count("*").alias("total")),
    )


def entity_view(
    entities: DataFrame,
    orgs: DataFrame,
    claims: DataFrame,
    counts: DataFrame,
    effective: DataFrame,
    decisions: DataFrame,
    title_rules: R.TitleRules = R.TitleRules(),
) -> DataFrame:
    """One wide line per entity.

    claims: resolved, with `applicable`. counts: lineage_counts. decisions: history with `valid`
    (see still_current). Every side is aggregated to one line per entity first.
    """
    check = effective.select(
        "entity_id", F.col("result").alias("verification"), F.col("checked_at").alias("verified_at")
    )
    sides = (view_values(field_facts(claims)), counts, check, view_verdicts(decisions))
    return assemble_view(with_org(entities, orgs), *sides, title_rules=title_rules)


def with_org(entities: DataFrame, orgs: DataFrame) -> DataFrame:
    """Entities with what a view shows of their organization."""
    shown = orgs.select("org_id", "canonical_name", "candidate_domain", "official_domain", "scope_path", "domain_verified")
    return entities.join(shown, "org_id", "left")


def view_values(facts: DataFrame) -> DataFrame:
    """field_facts (or facts_of) to one line per entity."""
    return facts.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}")
            for f in ("company", "title", *VIEW_FIELDS)
        ],
        F.count_if("conflict").alias("conflict_count"),
        F.count_if("differs").alias("historical_difference_count"),
        *_picked(),
    )


def view_verdicts(decisions: DataFrame) -> DataFrame:
    """History with `valid` to one line per entity: the current decision where it is valid, and that there is a past."""
    held = current_decisions(decisions).filter("valid")
    verdict = held.select("entity_id", "eligibility", "evidence_fit", "trust", "manual", F.lit(True).alias("decision_current"))
    past = decisions.select("entity_id").distinct().withColumn("_past", F.lit(True))
    return past.join(verdict, "entity_id", "left")


def assemble_view(
    base: DataFrame, values: DataFrame, counts: DataFrame, check: DataFrame, verdict: DataFrame, *,
    title_rules: R.TitleRules = R.TitleRules(), keep: Sequence[str] = (),
) -> DataFrame:
    """The wide line from sides of one line per entity each. `keep` names further columns of the sides."""
    for side in (values, counts, check, verdict):
        base = base.join(side, "entity_id", "left")
    own = F.coalesce("_title", F.when(F.col("observation_count").isNull(), F.col("title")), F.lit(""))
    shown = present_title(own, F.col("kind"), F.coalesce("_industry", F.lit("")), title_rules)

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(""))

    def items(name: str) -> Column:
        return F.coalesce(
            F.from_json(F.nullif(text(name), F.lit("")), "array<string>"), F.array().cast("array<string>")
        )

    current = F.coalesce("decision_current", F.lit(False))
    return base.withColumn("_shown", shown).select(
        "entity_id", "org_id", "kind", "review_status", "updated_at",
        F.coalesce(F.nullif("_company", F.lit("")), "canonical_name", F.lit("")).alias("company"),
        F.col("_shown.title").alias("title"),
        F.col("_shown.source_title").alias("source_title"),
        F.col("_shown.inferred").alias("title_inferred"),
        F.col("_shown.reason").alias("title_reason"),
        F.col("title").alias("display_title"),
        F.coalesce("canonical_name", F.lit("")).alias("canonical_name"),
        F.coalesce("official_job_id", F.lit("")).alias("official_job_id"),
        "candidate_domain", "official_domain", "scope_path", "domain_verified",
        items("cities").alias("cities"),
        items("graduation_years").alias("graduation_years"),
        *[text(f).alias(f) for f in VIEW_FIELDS[2:-2]],
        F.coalesce("_apply_url", "_announcement_url", F.lit("")).alias("apply_url"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"),
        F.coalesce("historical_difference_count", F.lit(0)).alias("historical_difference_count"),
        "verification", "verified_at", "eligibility", "evidence_fit", "trust",
        current.alias("decision_current"),
        (F.coalesce("_past", F.lit(False)) & ~current).alias("needs_recompute"),
        F.coalesce("_past", F.lit(False)).alias("has_history"),
        F.coalesce("manual", F.lit("UNDECIDED")).alias("manual"),
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
        *[f"sel_{f}" for f in SELECTED_FIELDS],
        "raw_company", "raw_title", *keep,
    )


def entity_detail(
    ids: DataFrame,
    matrix: DataFrame,
    origins: DataFrame,
    attempts: DataFrame,
    decisions: DataFrame,
    links: DataFrame,
) -> DataFrame:
    """Everything behind the given entities as (entity_id, section, rank_text, item) lines.

    One line per item keeps an entity with very many claims or origins out of a single value;
    `item` is the JSON of the item and `rank_text` the id to sort by inside a section.
    """
    wanted = ids.select("entity_id").distinct()

    def section(df: DataFrame, name: str, rank: Column) -> DataFrame:
        kept = fact_join(df, wanted.withColumn("_w", F.lit(True)), ["entity_id"]).filter("_w").drop("_w")
        return kept.select(
            "entity_id", F.lit(name).alias("section"), rank.cast("string").alias("rank_text"),
            F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("item"),
        )

    parts = [
        section(matrix, "claim", F.concat_ws(":", "field", "claim_id")),
        section(origins, "origin", F.col("raw_id")),
        section(attempts, "verification", F.col("verification_id")),
        section(decisions, "decision", F.col("decision_id")),
        section(links.withColumn("entity_id", F.col("campaign_id")), "linked_posting", F.col("posting_id")),
        section(links.withColumn("entity_id", F.col("posting_id")), "linked_campaign", F.col("campaign_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def queue_flags(entities: DataFrame, conflicts: DataFrame, decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities with `ready` and `verify_first`; one function serves counts and pages.

    conflicts: entity_id with a conflicting applicable claim. fresh: entity_id, has_fresh_open.
    """
    marked = conflicts.select("entity_id").distinct().withColumn("conflict", F.lit(True))
    joined = (
        entities.join(decision_marks(decisions), "entity_id", "left")
        .join(marked, "entity_id", "left")
        .join(fresh.select("entity_id", "has_fresh_open"), "entity_id", "left")
    )
    flags = queue_columns()
    return joined.select(*entities.columns, *[flag.alias(name) for name, flag in flags.items()])


def decision_marks(decisions: DataFrame) -> DataFrame:
    """What the current decisions of an entity say to the queues: one line per entity."""
    trusted = F.col("trust").isin(*VERIFIED) & (F.col("eligibility") == "PASS") & ~F.col("manual").isin(*PARKED)
    doubt = (F.col("manual") == "VERIFY_FIRST") | F.col("trust").isin(*UNSETTLED)
    return (
        decisions.filter("is_current")
        .groupBy("entity_id")
        .agg(
            F.lit(True).alias("has_decision"),
            F.max(trusted).alias("ready_decision"),
            F.max(doubt).alias("doubtful"),
            F.max(F.col("evidence_fit").isin("PRIMARY", "APPLY")).alias("fits"),
            F.max(F.col("eligibility").isin("PASS", "UNKNOWN")).alias("eligible"),
        )
    )


def queue_columns(conflict: str = "conflict", fresh_open: str = "has_fresh_open") -> dict[str, Column]:
    """ready, verify_first, fits and eligible over entity columns, decision_marks, a conflict mark and freshness."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    posting = F.col("kind") == POSTING
    live = F.col("review_status") != "MERGED"
    verify = (
        (F.col("kind") == CAMPAIGN) | flag(conflict) | ~flag("has_decision") | flag("doubtful")
        | (posting & ~flag(fresh_open))
    )
    return {
        "ready": live & posting & flag("ready_decision") & flag(fresh_open),
        "verify_first": live & verify,
        "fits": flag("fits"),
        "eligible": flag("eligible"),
    }


def queue_order(accepted_cities: Sequence[str] = (), keywords: Sequence[str] = ()) -> list[Column]:
    """Work order: eligible, preferred city, wanted role, fit, posting, newest."""

    def first(test: Column) -> Column:
        return F.when(test, 0).otherwise(1).asc()

    order = [first(F.col("eligible"))]
    if accepted_cities:
        members = F.coalesce(F.col("cities"), F.array().cast("array<string>"))
        order.append(first(F.arrays_overlap(members, F.array(*[F.lit(c) for c in accepted_cities]))))
    if keywords:
        order.append(first(has_any(F.lower("title"), [k.lower() for k in keywords])))
    return [
        *order, first(F.col("fits")), first(F.col("kind") == POSTING), F.col("updated_at").desc(), F.col("entity_id").asc(),
    ]


def ranked_queue(
    flagged: DataFrame, queue: str, page: int, size: int,
    accepted_cities: Sequence[str] = (), keywords: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """One page of the `ready` or `verify_first` queue and the queue's size."""
    return paginate(flagged.filter(F.col(queue)), queue_order(accepted_cities, keywords), page, size)


def dashboard(
    flagged: DataFrame, view: DataFrame, shortlist: DataFrame, batches: DataFrame, sources: DataFrame
) -> DataFrame:
    """One line of ten counters. Merged shells count in the totals but not in the queues.

    view: entity_id, has_conflict, ready_now, shortlist_ready.
    """
    joined = flagged.join(view.select("entity_id", "has_conflict", "ready_now", "shortlist_ready"), "entity_id", "left")
    return side_by_side(count_entities(joined, shortlist), *import_totals(batches, sources))


def count_entities(lines: DataFrame, shortlist: DataFrame) -> DataFrame:
    """The counters over entities. lines: entity_id, kind, verify_first, has_conflict, ready_now, shortlist_ready."""
    listed = shortlist.select("entity_id").withColumn("_listed", F.lit(True))
    return lines.join(listed, "entity_id", "left").agg(
        F.count("*").alias("opportunity_count"),
        F.count_if(F.col("kind") == POSTING).alias("posting_count"),
        F.count_if(F.col("kind") == CAMPAIGN).alias("campaign_count"),
        F.count_if("_listed").alias("shortlist_total_count"),
        F.count_if(F.col("_listed") & F.col("shortlist_ready")).alias("shortlist_ready_count"),
        F.count_if("ready_now").alias("ready_count"),
        F.count_if("verify_first").alias("verify_first_count"),
        F.count_if("has_conflict").alias("unresolved_conflict_count"),
    )


def import_totals(batches: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest import and the number of independent sources."""
    return (
        batches.agg(F.max("imported_at").alias("latest_import_at")),
        sources.agg(F.countDistinct("independence_group").alias("independent_source_count")),
    )


def top_pairs(pairs: DataFrame, entities: DataFrame, decision: str = "REVIEW", k: int = 50) -> DataFrame:
    """The k best pairs of a decision with a brief of both sides. Trimmed before the briefs join."""
    best = pairs.filter(F.col("decision") == decision).orderBy(
        F.col("score").desc(), F.col("left_id").asc(), F.col("right_id").asc()
    ).limit(k)

    def brief(name: str) -> DataFrame:
        return entities.select(
            F.col("entity_id").alias(f"{name}_id"),
            *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "title", "official_job_id", "review_status")],
        )

    return best.join(brief("left"), "left_id", "left").join(brief("right"), "right_id", "left")


def source_summary(sources: DataFrame, batches: DataFrame, raw: DataFrame) -> DataFrame:
    """Batches, raw rows and latest import per source, zero where there is nothing."""
    rows = raw.groupBy("batch_id").agg(F.count("*").alias("n"))
    per_source = (
        batches.join(rows, "batch_id", "left")
        .groupBy("source_id")
        .agg(
            F.count("*").alias("batch_count"),
            F.sum(F.coalesce("n", F.lit(0))).alias("raw_count"),
            F.max("imported_at").alias("latest_import_at"),
        )
    )
    return sources.join(per_source, "source_id", "left").withColumns(
        {"batch_count": F.coalesce("batch_count", F.lit(0)), "raw_count": F.coalesce("raw_count", F.lit(0))}
    )


def list_runs(runs: DataFrame, k: int = 20) -> DataFrame:
    if not 1 <= k <= 200:
        raise ValueError("k must be between 1 and 200")
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(k)


def list_changes(changes: DataFrame, change: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    kept = changes.filter(F.col("change") == change) if change else changes
    return kept.orderBy("change", "source_record_id").offset((page - 1) * size).limit(size)


def readiness(view: DataFrame, as_of: str, rules: R.DecisionRules = R.DecisionRules()) -> DataFrame:
    """View lines with ordered `blockers` and `is_ready`."""

    def block(test: Column, code: str) -> Column:
        return F.when(test, F.lit(code))

    posting = F.col("kind") == POSTING
    decided = F.col("decision_current")
    opened = F.coalesce(F.col("verification") == "OPEN", F.lit(False))
    stale = opened & ~F.coalesce(within(F.col("verified_at"), as_of, rules.max_age_days), F.lit(False))
    blockers = F.array_compact(
        F.array(
            block(~posting, "not_a_posting"),
            block(F.col("review_status") == "MERGED", "merged"),
            block(posting & (F.col("official_job_id") == ""), "posting_id_missing"),
            block(strip_text(F.col("title")) == "", "title_missing"),
            block(~decided & F.col("has_history"), "decision_stale"),
            block(~decided & ~F.col("has_history"), "decision_missing"),
            block(decided & (F.col("eligibility") != "PASS"), "not_eligible"),
            block(decided & ~F.col("trust").isin(*VERIFIED), "not_verified"),
            block(decided & F.col("manual").isin(*PARKED), "parked"),
            block(~opened, "not_open"),
            block(stale, "check_too_old"),
        )
    )
    return view.withColumn("blockers", blockers).withColumn("is_ready", F.size("blockers") == 0)


def shortlist_view(shortlist: DataFrame, ready: DataFrame) -> DataFrame:
    """Shortlist entries beside their entity and its readiness; display order is priority, then age."""
    return shortlist.join(ready.withColumnRenamed("is_ready", "ready"), "entity_id").withColumns(
        {"application_stage": F.coalesce("stage", F.lit("TO_APPLY"))}
    )


def shortlist_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("added_at").asc(), F.col("entity_id").asc()]


def update_shortlist(
    shortlist: DataFrame, commands: DataFrame, ready: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shortlist, verdict commands, rejected).

    commands: entity_id, action (ADD, REMOVE, STAGE), priority, note, stage, next_action,
    next_action_at, at. Adding passes the readiness gate and asks for a PREPARE_APPLY verdict;
    applied_at is set once. Commands act in the order of their time (then of their action). A
    removal ends an entry with all its progress; an entry added again begins anew, and only
    progress reported on it counts. Progress of an entity that is not listed then is refused.
    """
    gate = ready.select("entity_id", "is_ready", F.lit(True).alias("_known"))
    held = shortlist.withColumnsRenamed({c: f"_old_{c}" for c in shortlist.columns if c != "entity_id"}).withColumn("_held", F.lit(True))
    joined = fact_join(fact_join(commands, gate, ["entity_id"]), held.select("entity_id", "_held"), ["entity_id"])
    gated = joined.withColumn(
        "error",
        F.when((F.col("action") == "ADD") & F.col("_known").isNull(), "not_found")
        .when((F.col("action") == "ADD") & ~F.coalesce("is_ready", F.lit(False)), "not_ready")
        .when((F.col("action") == "STAGE") & ~F.col("stage").isin(*R.STAGES), "bad_stage"),
    )
    in_time = Window.partitionBy("entity_id").orderBy("at", "action").rowsBetween(Window.unboundedPreceding, 0)
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    moves = F.when(F.col("error").isNull() & F.col("action").isin("ADD", "REMOVE"), F.col("action"))
    judged = gated.withColumns(
        {
            "_period": F.count_if(F.col("action") == "REMOVE").over(in_time),
            "_listed": F.coalesce(F.last(moves, ignorenulls=True).over(before) == "ADD", F.col("_held"), F.lit(False)),
        }
    ).withColumn("error", F.coalesce("error", F.when((F.col("action") == "STAGE") & ~F.col("_listed"), F.lit("not_listed"))))
    good = judged.filter("error is null")
    add, stage = F.col("action") == "ADD", F.col("action") == "STAGE"
    newest = good.groupBy("entity_id").agg(
        F.max("_period").alias("p"),
        F.max(F.when(add, F.struct("_period", "at", "priority", "note"))).alias("m"),
        F.min(F.when(add, F.struct((-F.col("_period")).alias("q"), "at"))).alias("first"),
        F.max(F.when(stage, F.struct("_period", "at", "stage", "next_action", "next_action_at"))).alias("s"),
        F.min(F.when(stage & (F.col("stage") == "APPLIED"), F.struct((-F.col("_period")).alias("q"), "at"))).alias("a"),
    )
    kept = F.col("_held").isNotNull() & (F.coalesce("p", F.lit(0)) == 0)
    added = F.coalesce(F.col("m._period") == F.col("p"), F.lit(False))
    staged = F.coalesce(F.col("s._period") == F.col("p"), F.lit(False))
    both = held.join(newest, "entity_id", "full_outer").filter(kept | added)

    def old(name: str) -> Column:
        return F.when(kept, F.col(f"_old_{name}"))

    values = {
        "priority": F.when(added, F.col("m.priority")).otherwise(old("priority")),
        "note": F.when(added, F.col("m.note")).otherwise(old("note")),
        "stage": F.coalesce(F.when(staged, F.col("s.stage")), old("stage"), F.lit("TO_APPLY")),
        "next_action": F.coalesce(F.when(staged, F.trim("s.next_action")), old("next_action"), F.lit("")),
        "next_action_at": F.when(staged, F.col("s.next_action_at")).otherwise(old("next_action_at")),
        "applied_at": F.coalesce(old("applied_at"), F.when(-F.col("a.q") == F.col("p"), F.col("a.at"))),
        "added_at": F.coalesce(old("added_at"), F.col("first.at")),
    }
    out = both.select(*[("entity_id" if c == "entity_id" else values[c].alias(c)) for c in shortlist.columns])
    verdicts = newest.filter("m._period = p").select(
        "entity_id", F.lit("PREPARE_APPLY").alias("manual"), F.lit("added_to_shortlist").alias("reason"), F.col("m.at").alias("at")
    )
    return out, verdicts, judged.filter("error is not null").select("entity_id", "action", "error")


def stage_histogram(shortlist: DataFrame, stages: Sequence[str] = R.STAGES) -> DataFrame:
    """Entries per stage with every stage present."""
    counts = shortlist.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages])
    return counts.unpivot([], list(stages), "stage", "entries")


def keyword_search(
    view: DataFrame, keywords: Sequence[str], k: int, columns: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(top k of all hits, hits per keyword). A hit on several keywords is listed once.

    Keywords are tested in one pass over the view; there is no join with the keyword list.
    """
    names = columns or {"title": "title", "company": "company"}
    text = [F.lower(clean_text(F.col(c))) for c in names.values()]
    flags = []
    for word in keywords:
        hit = F.lit(False)
        for t in text:
            hit = hit | t.contains(word.strip().lower())
        flags.append(hit)
    tested = view.withColumn("_hits", F.array(*flags))
    totals = tested.agg(
        *[F.count_if(F.get("_hits", F.lit(i))).alias(f"k{i}") for i in range(len(keywords))]
    ).unpivot([], [f"k{i}" for i in range(len(keywords))], "slot", "total")
    label = F.element_at(
        F.array(*[F.lit(w) for w in keywords]), F.substring("slot", 2, 9).cast("int") + 1
    )
    found = tested.filter(F.exists("_hits", lambda x: x)).drop("_hits")
    top = found.orderBy(
        F.when(F.coalesce("official_job_id", F.lit("")) == "", 1).otherwise(0),
        F.when(F.coalesce("apply_url", F.lit("")) == "", 1).otherwise(0),
        names["company"],
        names["title"],
        "entity_id",
    ).limit(k)
    return top, totals.select(label.alias("keyword"), "total")


def newest_per(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_per_group(df, [key], order)
