"""Three-axis decisions: eligibility, evidence fit and trust, with reasons, unknowns and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import CAMPAIGN, POSTING, present_title
from accordant.functions.text import clean_set, extract_years, fold_category, let, rank_of, strip_text, tag_text
from accordant.functions.times import moment, older_than, within
from accordant.operators.claims import usable_claims
from accordant.session import fact_join

CONTEXT_FIELDS = (
    "company", "title", "cities", "graduation_years", "education", "recruitment_type", "industry",
    "deadline", "announcement_url", "apply_url",
)
LIST_TYPE = "array<string>"
REASON = "struct<code:string,field:string,refs:array<string>>"
UNKNOWN = "struct<code:string,field:string>"


def _none() -> Column:
    return F.array().cast(LIST_TYPE)


def _reason(test: Column, code: str, field: str, refs: Column | None = None) -> Column:
    value = F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), (_none() if refs is None else refs).alias("refs")
    )
    return F.when(test, value).cast(REASON)


def _unknown(test: Column, code: str, field: str) -> Column:
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))).cast(UNKNOWN)


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def build_context(
    entities: DataFrame,
    orgs: DataFrame,
    values: DataFrame,
    effective: DataFrame,
    lines: DataFrame,
    notes: DataFrame,
    as_of: str,
    rules: R.DecisionRules = R.DecisionRules(),
    title_rules: R.TitleRules = R.TitleRules(),
) -> DataFrame:
    """One line per entity with all a decision looks at.

    values: fresh_values; effective: effective_attempt; lines: lineage; notes: raw_id, created_at,
    notes. All inputs are aggregated to one line per entity before the joins.
    """
    facts = values.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value_key"))).alias(f"_{f}") for f in CONTEXT_FIELDS],
        F.array_sort(F.collect_set(F.when(F.col("in_conflict"), F.col("field")))).alias("conflicting_fields"),
        F.max("raw_seen_at").alias("claim_seen_at"),
    )
    same = F.col("raw_kind") == F.col("kind")
    per_group = lines.groupBy("entity_id", "independence_group").agg(
        F.max(same & within(F.col("seen_at"), as_of, rules.max_age_days)).alias("fresh"),
        F.max(F.when(same, F.col("seen_at"))).alias("seen_at"),
    )
    sources = per_group.groupBy("entity_id").agg(
        F.count_if("fresh").alias("source_count"), F.max("seen_at").alias("origin_seen_at")
    )
    noted = (
        lines.filter(same)
        .join(notes, "raw_id")
        .groupBy("entity_id")
        .agg(F.max(F.struct("created_at", "raw_id", "notes")).alias("n"))
        .select("entity_id", F.col("n.notes").alias("notes"))
    )
    checked = effective.select(
        "entity_id", F.col("result").alias("verification_result"), F.col("checked_at").alias("official_checked_at")
    )
    named = entities.join(orgs.select("org_id", "canonical_name"), "org_id", "left")
    joined = (
        named.join(facts, "entity_id", "left")
        .join(sources, "entity_id", "left")
        .join(noted, "entity_id", "left")
        .join(checked, "entity_id", "left")
    )

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(""))

    def items(name: str) -> Column:
        return F.coalesce(F.from_json(F.nullif(text(name), F.lit("")), LIST_TYPE), _none())

    own = F.coalesce(F.nullif(text("title"), F.lit("")), F.when(F.col("origin_seen_at").isNull(), F.col("title")), F.lit(""))
    shown = present_title(own, F.col("kind"), text("industry"), title_rules)["title"]
    return joined.select(
        "entity_id", "org_id", "kind", "review_status",
        F.coalesce("official_job_id", F.lit("")).alias("official_job_id"),
        F.coalesce("canonical_name", text("company")).alias("company"),
        F.when(F.col("kind") == CAMPAIGN, shown).otherwise(own).alias("title"),
        *[items(f).alias(f) for f in R.LIST_FIELDS],
        text("recruitment_type").alias("recruitment_type"),
        text("deadline").alias("deadline"),
        text("announcement_url").alias("announcement_url"),
        text("apply_url").alias("apply_url"),
        F.coalesce("notes", F.lit("")).alias("jd_text"),
        F.coalesce("verification_result", F.lit("UNKNOWN")).alias("verification_result"),
        "official_checked_at",
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        ((F.col("kind") == POSTING) & F.col("verification_result").isNotNull()).alias("official_specific_posting"),
        F.greatest("claim_seen_at", "origin_seen_at").alias("latest_source_at"),
        F.coalesce("conflicting_fields", _none()).alias("conflicting_fields"),
    )


def eligibility(rules: R.DecisionRules = R.DecisionRules()) -> Column:
    """struct<result, reasons, unknowns> over context and profile columns."""
    status = F.col("verification_result")
    accepted = F.coalesce(F.col("accepted_cities"), _none())
    cities = clean_set(F.col("cities"))
    mine = F.coalesce(F.col("years"), _none())
    asked = extract_years(F.coalesce(F.col("graduation_years"), _none()), rules.year_pattern)
    degrees = rank_of(F.coalesce(F.col("profile_education"), _none()), rules.education_rank, exact=True)
    floor = rank_of(F.coalesce(F.col("education"), _none()), rules.education_rank)
    types = F.coalesce(F.col("accepted_types"), _none())
    offered = fold_category(F.coalesce(F.col("recruitment_type"), F.lit("")), rules.type_folding)
    facts = F.struct(
        cities.alias("cities"), asked.alias("asked"), degrees.alias("degrees"), floor.alias("floor"),
        offered.alias("offered"),
    )

    def judge(f: Column) -> Column:
        has_wish, has_city = F.size(accepted) > 0, F.size(f["cities"]) > 0
        city_ok = F.array_contains(f["cities"], rules.anywhere) | F.arrays_overlap(accepted, f["cities"])
        has_year, asks_year = F.size(mine) > 0, F.size(f["asked"]) > 0
        year_ok = F.arrays_overlap(mine, f["asked"])
        has_degree, asks_degree = F.size(f["degrees"]) > 0, F.size(f["floor"]) > 0
        degree_ok = F.array_max(f["degrees"]) >= F.array_min(f["floor"])
        has_type, offers = F.size(types) > 0, f["offered"] != ""
        type_ok = F.array_contains(types, f["offered"])
        closed, opened = status == "CLOSED", status == "OPEN"
        fails = (
            closed
            | (has_wish & has_city & ~city_ok)
            | (has_year & asks_year & ~year_ok)
            | (has_degree & asks_degree & ~degree_ok)
            | (has_type & offers & ~type_ok)
        )
        reasons = _list(
            _reason(closed, "officially_closed", "status"),
            _reason(opened, "officially_open", "status"),
            _reason(has_wish & has_city & city_ok, "city_accepted", "cities"),
            _reason(has_wish & has_city & ~city_ok, "city_not_accepted", "cities"),
            _reason(
                has_year & asks_year & year_ok, "graduation_year_matches", "graduation_years",
                F.coalesce(F.col("year_refs"), _none()),
            ),
            _reason(has_year & asks_year & ~year_ok, "graduation_year_mismatch", "graduation_years"),
            _reason(
                has_degree & asks_degree & degree_ok, "education_meets_minimum", "education",
                F.coalesce(F.col("education_refs"), _none()),
            ),
            _reason(has_degree & asks_degree & ~degree_ok, "education_below_minimum", "education"),
            _reason(has_type & offers & type_ok, "recruitment_type_accepted", "recruitment_type"),
            _reason(has_type & offers & ~type_ok, "recruitment_type_not_accepted", "recruitment_type"),
        )
        unknowns = _list(
            _unknown(~closed & ~opened, "status_not_confirmed", "status"),
            _unknown(~has_wish, "accepted_cities_missing", "preferences.accepted_cities"),
            _unknown(has_wish & ~has_city, "posting_city_missing", "cities"),
            _unknown(~has_year, "candidate_graduation_unconfirmed", "profile.facts.graduation_year"),
            _unknown(has_year & ~asks_year, "posting_graduation_missing", "graduation_years"),
            _unknown(~has_degree, "candidate_education_unconfirmed", "profile.facts.education"),
            _unknown(has_degree & ~asks_degree, "posting_education_missing", "education"),
            _unknown(~has_type, "accepted_recruitment_types_missing", "preferences.accepted_recruitment_types"),
            _unknown(has_type & ~offers, "posting_recruitment_type_missing", "recruitment_type"),
        )
        campaign = F.struct(
            F.lit("UNKNOWN").alias("result"),
            _list(_reason(F.lit(True), "campaign_not_posting", "opportunity_kind")).alias("reasons"),
            _list(_unknown(F.lit(True), "posting_required", "posting")).alias("unknowns"),
        )
        posting = let(
            unknowns,
            lambda u: F.struct(
                F.when(fails, "FAIL").when(F.size(u) > 0, "UNKNOWN").otherwise("PASS").alias("result"),
                reasons.alias("reasons"),
                u.alias("unknowns"),
            ),
        )
        return F.when(F.col("kind") == CAMPAIGN, campaign).otherwise(posting)

    return let(facts, judge)


def evidence_fit(rules: R.DecisionRules = R.DecisionRules()) -> Column:
    """struct<result, reasons, unknowns>: how far confirmed facts cover what the text asks for."""
    text = strip_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("jd_text", F.lit(""))))
    tags = F.col("tags")

    def judge(required: Column) -> Column:
        matched = F.filter(
            required, lambda t: F.coalesce(F.array_contains(F.map_keys(tags), t), F.lit(False))
        )
        return let(matched, lambda m: outcome(required, m))

    def outcome(required: Column, matched: Column) -> Column:
        coverage = F.size(matched) / F.when(F.size(required) > 0, F.size(required))
        spans = F.size(
            F.array_distinct(
                F.transform(
                    F.flatten(F.transform(matched, lambda t: F.element_at(tags, t))),
                    lambda e: F.struct(e["start"], e["end"]),
                )
            )
        )
        no_target, no_facts = F.size(required) == 0, ~F.coalesce(F.col("has_evidence"), F.lit(False))
        nothing = F.size(matched) == 0
        result = (
            F.when(no_target | no_facts, "UNKNOWN")
            .when(nothing, "LOW")
            .when(
                (F.size(matched) >= rules.primary_matches)
                & (coverage >= rules.primary_coverage)
                & (spans >= rules.primary_spans),
                "PRIMARY",
            )
            .when((F.size(matched) >= rules.apply_matches) | (coverage >= rules.apply_coverage), "APPLY")
            .otherwise("STRETCH")
        )
        supported = F.transform(
            matched,
            lambda t: F.struct(
                F.concat(F.lit("supported_capability_match:"), t).alias("code"),
                F.lit("profile.facts").alias("field"),
                F.array_sort(F.array_distinct(F.transform(F.element_at(tags, t), lambda e: e["fact_id"]))).alias("refs"),
            ),
        ).cast(f"array<{REASON}>")
        low = _list(_reason(nothing, "no_supported_capability_match", "profile.facts"))
        empty = F.array().cast(f"array<{REASON}>")
        return F.struct(
            result.alias("result"),
            F.when(no_target | no_facts, empty).when(nothing, low).otherwise(supported).alias("reasons"),
            _list(
                _unknown(no_target, "no_target_capabilities", "jd_text"),
                _unknown(~no_target & no_facts, "no_confirmed_profile_facts", "profile.facts"),
            ).alias("unknowns"),
        )

    return let(tag_text(text, rules.dictionary), judge)


def trust(as_of: str, rules: R.DecisionRules = R.DecisionRules()) -> Column:
    """struct<result, reasons, unknowns>: what the evidence is worth at `as_of`."""
    status = F.col("verification_result")
    unresolved = status.isin("NOT_FOUND", "BLOCKED")
    # The official check counts alone where there is one, even if older than the sources.
    freshest = F.coalesce("official_checked_at", "latest_source_at")
    stale = F.coalesce(older_than(freshest, as_of, rules.max_age_days), F.lit(False))
    verified = F.col("official_specific_posting") & status.isin("OPEN", "CLOSED")
    conflicts = F.size("conflicting_fields") > 0
    many = F.col("source_count") >= 2

    def outcome(result: str, reasons: list[Column], unknowns: list[Column]) -> Column:
        return F.struct(
            F.lit(result).alias("result"),
            (_list(*reasons) if reasons else F.array().cast(f"array<{REASON}>")).alias("reasons"),
            (_list(*unknowns) if unknowns else F.array().cast(f"array<{UNKNOWN}>")).alias("unknowns"),
        )

    yes = F.lit(True)
    return (
        F.when(
            unresolved,
            outcome(
                "UNKNOWN",
                [
                    _reason(status == "NOT_FOUND", "official_not_found", "verification_result"),
                    _reason(status == "BLOCKED", "official_blocked", "verification_result"),
                ],
                [_unknown(yes, "official_status_unresolved", "status")],
            ),
        )
        .when(stale, outcome("STALE", [_reason(yes, "evidence_stale", "official_checked_at")], []))
        .when(
            verified & conflicts,
            outcome(
                "VERIFIED_WITH_CONFLICT",
                [_reason(yes, "official_posting_with_conflicts", "conflicting_fields")],
                [],
            ),
        )
        .when(
            verified,
            outcome("VERIFIED", [_reason(yes, "official_specific_posting_verified", "verification_result")], []),
        )
        .when(
            conflicts,
            outcome("CONFLICTED", [_reason(yes, "unresolved_source_conflicts", "conflicting_fields")], []),
        )
        .when(
            many,
            outcome(
                "CONSISTENT",
                [_reason(yes, "multiple_sources_consistent", "source_count")],
                [_unknown(yes, "official_posting_not_verified", "official_specific_posting")],
            ),
        )
        .otherwise(outcome("UNKNOWN", [], [_unknown(yes, "insufficient_source_evidence", "source_count")]))
    )


def with_profiles(contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Contexts (with profile_id) beside their profile; every context may share one profile."""
    return fact_join(contexts, profiles.withColumnRenamed("education", "profile_education"), ["profile_id"])


def fingerprint() -> Column:
    """Rule version: changes whenever facts, hard preferences or the context change."""
    parts = F.struct(
        F.coalesce("facts_hash", F.lit("")).alias("facts"),
        F.coalesce("accepted_cities", _none()).alias("accepted_cities"),
        F.coalesce("accepted_types", _none()).alias("accepted_types"),
        F.struct(
            "company", "title", "cities", "graduation_years", "education", "recruitment_type", "jd_text", "kind",
            "verification_result", "official_checked_at", "source_count", "latest_source_at", "conflicting_fields",
        ).alias("context"),
    )
    return F.concat(F.lit("v1|profile:"), F.substring(F.sha2(F.to_json(parts), 256), 1, 16))


def decide(
    contexts: DataFrame, profiles: DataFrame, as_of: str, rules: R.DecisionRules = R.DecisionRules()
) -> DataFrame:
    """One decision line per context: three results, reasons and unknowns by axis, references."""
    axes = ("eligibility", "evidence_fit", "trust")
    judged = with_profiles(contexts, profiles).withColumns(
        {"_eligibility": eligibility(rules), "_evidence_fit": evidence_fit(rules), "_trust": trust(as_of, rules)}
    )

    def tagged(part: str, members: tuple[str, ...]) -> Column:
        def one(axis: str) -> Column:
            return F.transform(
                F.col(f"_{axis}.{part}"),
                lambda x: F.struct(F.lit(axis).alias("axis"), *[x[m].alias(m) for m in members]),
            )

        return F.concat(*[one(axis) for axis in axes])

    out = judged.select(
        "entity_id", "profile_id",
        *[F.col(f"_{axis}.result").alias(axis) for axis in axes],
        tagged("reasons", ("code", "field", "refs")).alias("reasons"),
        tagged("unknowns", ("code", "field")).alias("unknowns"),
        fingerprint().alias("fingerprint"),
        moment(as_of).alias("created_at"),
    )
    return out.withColumn(
        "evidence_refs", F.array_sort(F.array_distinct(F.flatten(F.transform("reasons", lambda r: r["refs"]))))
    )


NEWEST = ("created_at", "decision_id")


def decision_key(*tables: DataFrame) -> list[str]:
    """What a decision is about: an entity, and a profile where all tables know it."""
    return [c for c in ("entity_id", "profile_id") if all(c in t.columns for t in tables)]


def store_decisions(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with the new lines current; manual verdicts carry over from the newest old line."""
    key = decision_key(history, new)
    last = history.groupBy(*key).agg(F.max(F.struct(*NEWEST, "manual", "override_reason")).alias("_last"))
    touched = new.select(*key).distinct().withColumn("_new", F.lit(True))
    old = fact_join(history, touched, key).withColumn(
        "is_current", F.col("is_current") & F.col("_new").isNull()
    ).select(*history.columns)
    added = new.join(last, key, "left").withColumns(
        {
            "decision_id": F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.col("created_at").cast("string")),
            "is_current": F.lit(True),
            "manual": F.coalesce("_last.manual", F.lit("UNDECIDED")),
            "override_reason": F.coalesce("_last.override_reason", F.lit("")),
        }
    )
    types = dict(history.dtypes)
    columns = [
        F.col(c).cast(types[c]) if c in added.columns else F.lit(None).cast(types[c]).alias(c) for c in history.columns
    ]
    return old.unionByName(added.select(*columns))


def invalidate(history: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Nothing is current any more: everywhere (None) or for the given entities only."""
    if keys is None:
        return history.withColumn("is_current", F.lit(False))
    key = decision_key(history, keys)
    hit = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    return fact_join(history, hit, key).withColumn(
        "is_current", F.col("is_current") & F.col("_hit").isNull()
    ).select(*history.columns)


def still_current(history: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Add `valid`: current, and a recomputation gives the same trust and fingerprint."""
    key = decision_key(history, recomputed)
    now = recomputed.select(*key, F.col("trust").alias("_trust"), F.col("fingerprint").alias("_fingerprint"))
    same = (F.col("trust") == F.col("_trust")) & (F.col("fingerprint") == F.col("_fingerprint"))
    return fact_join(history, now, key).withColumn(
        "valid", F.col("is_current") & F.coalesce(same, F.lit(False))
    ).select(*history.columns, "valid")


def first_expiry(claims: DataFrame, lines: DataFrame, effective: DataFrame, as_of: str, max_age_days: float) -> DataFrame:
    """(entity_id, valid_until): the last instant at which all that is fresh at `as_of` still is.

    Up to then time alone changes no context and no decision. What expires are imported and verified claims that say
    something, the newest row of each independence group, and the effective check. Entities with
    nothing fresh are left out: nothing of theirs can expire.
    """
    def fresh(moment_of: Column) -> Column:
        return F.when(within(moment_of, as_of, max_age_days), moment_of)

    dated = F.col("raw_id").isNotNull() | F.col("verification_id").isNotNull()
    said = usable_claims(claims).filter("_full").filter(dated)
    same = F.col("raw_kind") == F.col("kind")
    groups = lines.filter(same).groupBy("entity_id", "independence_group").agg(F.max("seen_at").alias("seen_at"))
    moments = [
        said.groupBy("entity_id").agg(F.min(fresh(F.col("observed_at"))).alias("first")),
        groups.groupBy("entity_id").agg(F.min(fresh(F.col("seen_at"))).alias("first")),
        effective.select("entity_id", fresh(F.col("checked_at")).alias("first")),
    ]
    found = moments[0].unionByName(moments[1]).unionByName(moments[2]).groupBy("entity_id").agg(F.min("first").alias("first"))
    age = F.make_dt_interval(secs=F.lit(float(max_age_days) * 86400.0))
    return found.filter("first is not null").select("entity_id", (F.col("first") + age).alias("valid_until"))


def by_expiry(decisions: DataFrame, expiry: DataFrame) -> DataFrame:
    """Decisions with `valid_until`, dealt out and sorted by it, so that a stored table is read by ranges of it."""
    dated = fact_join(decisions, expiry, ["entity_id"])
    return dated.repartitionByRange(F.col("valid_until").asc_nulls_last()).sortWithinPartitions(F.col("valid_until").asc_nulls_last())


def due_decisions(dated: DataFrame, as_of: str, changed: DataFrame | None = None) -> DataFrame:
    """(entity_id): whose current decision time has passed, a range of the stored order, and whose facts changed."""
    passed = dated.filter(F.col("valid_until") < moment(as_of)).filter("is_current").select("entity_id")
    if changed is not None:
        passed = passed.unionByName(changed.select("entity_id"))
    return passed.distinct()


def recheck(dated: DataFrame, due: DataFrame, again: DataFrame) -> DataFrame:
    """History with `valid` as still_current gives it, from a recomputation (`again`) of the due entities alone.

    A current decision that is not due holds; one that is due holds if it came out the same.
    """
    asked = fact_join(dated, due.select("entity_id").distinct().withColumn("_due", F.lit(True)), ["entity_id"])
    key = decision_key(dated, again)
    now = again.select(*key, F.col("trust").alias("_trust"), F.col("fingerprint").alias("_fingerprint"))
    same = (F.col("trust") == F.col("_trust")) & (F.col("fingerprint") == F.col("_fingerprint"))
    holds = F.col("_due").isNull() | F.coalesce(same, F.lit(False))
    return fact_join(asked, now, key).withColumn("valid", F.col("is_current") & holds).select(*dated.columns, "valid")


def reconcile_stale(history: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Switch off current lines that no longer hold."""
    return still_current(history, recomputed).withColumn("is_current", F.col("valid")).drop("valid")


def recompute(
    contexts: DataFrame,
    profiles: DataFrame,
    history: DataFrame,
    as_of: str,
    keys: DataFrame | None = None,
    rules: R.DecisionRules = R.DecisionRules(),
) -> DataFrame:
    """New decisions for all live entities, or for the given ones; None means all, empty means none."""
    live = contexts.filter("review_status <> 'MERGED'")
    if keys is not None:
        live = live.join(keys.select("entity_id").distinct(), "entity_id", "left_semi")
    return store_decisions(history, decide(live, profiles, as_of, rules))


def override_decisions(
    history: DataFrame, commands: DataFrame, recomputed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(history, rejected). commands: entity_id, manual, reason, at; several are applied by time.

    A verdict needs a reason unless it is UNDECIDED, and a current decision to attach to. Every
    override is a new line; the last one (by time, verdict and reason) is current. Given
    `recomputed` (as decide() makes it), a decision that no longer holds is replaced by the new
    one first, so that no verdict attaches to a stale line.
    """
    key = decision_key(history, commands)
    if recomputed is not None:
        stale = still_current(history, recomputed).filter("is_current and not valid").select(*decision_key(history, recomputed))
        asked = commands.select(*key).distinct()
        fresh = recomputed.join(stale.distinct(), stale.columns, "left_semi").join(asked, key, "left_semi")
        history = store_decisions(history, fresh)
    current = current_decisions(history)
    held = current.select(*key, F.struct(*history.columns).alias("_d"))
    asked = commands.select(*key, F.col("manual").alias("_manual"), F.col("reason").alias("_why"), "at").distinct()
    judged = fact_join(asked, held, key)
    judged = judged.withColumn(
        "error",
        F.when((F.col("_manual") != "UNDECIDED") & (F.trim("_why") == ""), "reason_missing").when(
            F.col("_d").isNull(), "no_current_decision"
        ),
    )
    good = judged.filter("error is null")
    order = F.struct("at", "_manual", "_why")
    last = good.groupBy(*key).agg(F.max(order).alias("_last"))
    replaced = {
        "decision_id": F.concat_ws(
            ":", *[F.col(c).cast("string") for c in key], F.lit("manual"), F.col("at").cast("string"), "_manual",
            F.substring(F.sha2("_why", 256), 1, 8),
        ),
        "manual": F.col("_manual"),
        "override_reason": F.col("_why"),
        "created_at": F.col("at"),
        "is_current": order == F.col("_last"),
        **{c: F.col(c) for c in key},
    }
    added = fact_join(good, last, key, "inner").select(
        *[replaced.get(c, F.col(f"_d.{c}")).alias(c) for c in history.columns]
    )
    out = invalidate(history, last).unionByName(added)
    return out, judged.filter("error is not null").select("entity_id", "error")


def current_decisions(history: DataFrame) -> DataFrame:
    """The newest current line per entity (and profile)."""
    key = decision_key(history)
    line = F.struct(*NEWEST, *[c for c in history.columns if c not in (*NEWEST, *key)])
    flat = history.filter("is_current").groupBy(*key).agg(F.max_by(line, F.struct(*NEWEST)).alias("d"))
    return flat.select(*[F.col(c) if c in key else F.col(f"d.{c}") for c in history.columns])


def keep_newest_current(history: DataFrame) -> DataFrame:
    """Repair: older lines that are also marked current lose the mark."""
    key = decision_key(history)
    newest = history.filter("is_current").groupBy(*key).agg(F.max(F.struct(*NEWEST)).alias("_top"))
    return fact_join(history, newest, key).withColumn(
        "is_current", F.col("is_current") & (F.struct(*NEWEST) == F.col("_top"))
    ).select(*history.columns)
