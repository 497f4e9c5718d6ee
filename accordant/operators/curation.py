"""Curation commands as joins against the working tables.

`state` is a dict of DataFrames: orgs, entities, origins, raw, claims, attempts, decisions, links,
shortlist. Every function returns a new dict and the refused commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import CAMPAIGN, POSTING
from accordant.functions.url import mark_registrable, official_scope, scope_host
from accordant.operators.claims import applicable_claims, resolve_claims, retire_claims
from accordant.operators.decisions import invalidate
from accordant.operators.graph import contract
from accordant.operators.verification import validate_identity_url
from accordant.session import checkpoint, fact_join

State = dict[str, DataFrame]


def _last(commands: DataFrame, key: str) -> DataFrame:
    """The newest command per key."""
    rest = [c for c in commands.columns if c not in (key, "at")]
    return (
        commands.groupBy(key)
        .agg(F.max(F.struct("at", *rest)).alias("c"))
        .select(key, "c.at", *[f"c.{c}" for c in rest])
    )


def refresh_entities(state: State, keys: DataFrame) -> State:
    """Resolve all claims of the entities in `keys` again and mark their decisions stale."""
    ids = keys.select("entity_id").distinct()
    mark = ids.withColumn("_again", F.lit(True))
    marked = fact_join(state["claims"], mark, ["entity_id"])
    again = applicable_claims(
        marked.filter("_again").drop("_again"), state["raw"], state["attempts"], state["entities"], state["orgs"]
    )
    columns = state["claims"].columns
    claims = marked.filter("_again is null").select(*columns).unionByName(resolve_claims(again, counted=state["claims"]).select(*columns))
    return {**state, "claims": claims, "decisions": invalidate(state["decisions"], ids)}


def confirm_domains(
    state: State, commands: DataFrame, scope_rules: R.ScopeRules = R.ScopeRules(), suffixes: DataFrame | None = None
) -> tuple[State, DataFrame]:
    """Anchor organizations. commands: entity_id, domain_text, at.

    suffixes: a public suffix list (see mark_registrable); without it the suffixes of the rules are all.
    """
    entities, orgs = state["entities"], state["orgs"]
    registrable = None
    if suffixes is not None:
        commands = mark_registrable(commands, scope_host(F.col("domain_text")), suffixes, "_registrable")
        registrable = F.col("_registrable")
    scoped = (
        commands.join(entities.select("entity_id", "org_id"), "entity_id", "left")
        .withColumn("s", official_scope(F.col("domain_text"), scope_rules, registrable))
        .withColumns({"new_domain": F.col("s.domain"), "new_path": F.col("s.scope_path")})
    )
    names = orgs.select("org_id", "normalized_name")
    held = (
        orgs.filter("official_domain <> ''")
        .groupBy("normalized_name", F.col("official_domain").alias("new_domain"))
        .agg(F.min("org_id").alias("_lo"), F.max("org_id").alias("_hi"))
    )
    judged = fact_join(scoped.join(names, "org_id", "left"), held, ["normalized_name", "new_domain"]).withColumn(
        "error",
        F.when(F.col("org_id").isNull(), "not_found")
        .when(F.col("s.error").isNotNull(), F.col("s.error"))
        .when((F.col("_lo") != F.col("org_id")) | (F.col("_hi") != F.col("org_id")), "domain_held_by_namesake"),
    )
    last = _last(judged.filter("error is null").select("org_id", "at", "new_domain", "new_path"), "org_id")
    changed = orgs.join(last, "org_id", "left")
    hit = F.col("new_domain").isNotNull()
    new_orgs = changed.select(
        *[c for c in orgs.columns if c not in ("candidate_domain", "official_domain", "scope_path", "domain_verified")],
        F.when(hit, F.col("new_domain")).otherwise(F.col("candidate_domain")).alias("candidate_domain"),
        F.when(hit, F.col("new_domain")).otherwise(F.col("official_domain")).alias("official_domain"),
        F.when(hit, F.col("new_path")).otherwise(F.col("scope_path")).alias("scope_path"),
        (hit | F.coalesce("domain_verified", F.lit(False))).alias("domain_verified"),
    ).select(*orgs.columns)
    affected = entities.join(last.select("org_id"), "org_id", "left_semi")
    moved = refresh_entities({**state, "orgs": new_orgs}, affected)
    return moved, judged.filter("error is not null").select("entity_id", "error")


def confirm_identities(
    state: State,
    commands: DataFrame,
    scope_rules: R.ScopeRules = R.ScopeRules(),
    id_rules: R.IdRules = R.IdRules(),
) -> tuple[State, DataFrame]:
    """Bind posting ids. commands: entity_id, official_job_id, url, at."""
    entities, orgs = state["entities"], state["orgs"]
    wanted = commands.withColumn("official_job_id", F.lower(F.trim("official_job_id")))
    checked = validate_identity_url(wanted, entities, orgs, scope_rules, id_rules)
    judged = checked.join(entities.select("entity_id", "org_id"), "entity_id", "left")
    # An id may be held by one live entity of the organization only; commands of one load that ask
    # for the same id are decided by time.
    holders = (
        entities.filter("review_status <> 'MERGED' and coalesce(official_job_id, '') <> ''")
        .groupBy("org_id", F.lower("official_job_id").alias("official_job_id"))
        .agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi"))
    )
    judged = fact_join(judged, holders, ["org_id", "official_job_id"])
    me = F.col("entity_id")
    judged = judged.withColumn(
        "error",
        F.when(F.col("_kind").isNull(), "not_found")
        .when(F.col("_kind") != POSTING, "not_a_posting")
        .when((F.col("_job") != "") & (F.lower("_job") != F.col("official_job_id")), "other_id_bound")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when((F.col("_lo") != me) | (F.col("_hi") != me), "id_held_by_other"),
    )
    good = judged.filter("error is null")
    first = good.groupBy("org_id", "official_job_id").agg(F.min(F.struct("at", "entity_id")).alias("_w"))
    raced = fact_join(good, first, ["org_id", "official_job_id"], "inner")
    lost = raced.filter(F.col("_w.entity_id") != me).select("entity_id", F.lit("id_held_by_other").alias("error"))
    won = _last(
        raced.filter(F.col("_w.entity_id") == me).select("entity_id", "at", "official_job_id", "canonical_url"),
        "entity_id",
    )
    bound = won.select("entity_id", F.col("official_job_id").alias("_id"))
    named = entities.join(bound, "entity_id", "left").join(orgs.select("org_id", "normalized_name"), "org_id", "left")
    new_entities = named.withColumns(
        {
            "official_job_id": F.coalesce("_id", "official_job_id"),
            "canonical_key": F.when(
                F.col("_id").isNotNull(),
                F.concat(F.lit("official-job:"), F.coalesce("normalized_name", F.col("org_id").cast("string")), F.lit(":"), "_id"),
            ).otherwise(F.col("canonical_key")),
        }
    ).select(*entities.columns)
    columns = state["claims"].columns
    fresh = won.select(
        "entity_id",
        F.lit(None).cast("string").alias("raw_id"),
        F.lit(None).cast("string").alias("verification_id"),
        F.lit("official_job_id").alias("field"),
        F.col("official_job_id").alias("raw_value"),
        F.col("official_job_id").alias("value_key"),
        F.lit(R.AUTHORITY_USER).alias("authority"),
        F.col("at").alias("observed_at"),
        F.col("at").alias("created_at"),
        F.lit("manual:user-confirmed-identity").alias("source_key"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("active"),
        F.lit(False).alias("selected"),
        F.lit("").alias("reason"),
        F.concat_ws(":", F.lit("identity"), F.col("entity_id").cast("string"), F.col("at").cast("string")).alias("claim_id"),
    )
    for name in columns:
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(None).cast(dict(state["claims"].dtypes)[name]))
    retired = retire_claims(
        state["claims"], won.select("entity_id", "at", F.lit("replaced_by_later_identity").alias("reason"))
    )
    claims = retired.unionByName(fresh.select(*columns))
    moved = refresh_entities({**state, "entities": new_entities, "claims": claims}, won)
    refused = judged.filter("error is not null").select("entity_id", "error").unionByName(lost)
    return moved, refused


def reclassify(state: State, commands: DataFrame) -> tuple[State, DataFrame]:
    """Change kinds. commands: entity_id, new_kind, at."""
    entities = state["entities"]
    last = _last(commands.select("entity_id", "at", "new_kind"), "entity_id")
    judged = last.join(
        entities.select("entity_id", F.col("kind").alias("old_kind"), "org_id"), "entity_id", "left"
    ).withColumn(
        "error",
        F.when(F.col("old_kind").isNull(), "not_found")
        .when(~F.col("new_kind").isin(CAMPAIGN, POSTING), "bad_kind")
        .when(F.col("old_kind") == F.col("new_kind"), "unchanged"),
    )
    moved = judged.filter("error is null").select("entity_id", "at", "new_kind", "old_kind")
    to_campaign = moved.filter(F.col("new_kind") == CAMPAIGN)
    dropped = F.col("new_kind") == CAMPAIGN
    org_name = state["orgs"].select("org_id", "normalized_name")
    new_entities = (
        entities.join(moved.select("entity_id", "new_kind"), "entity_id", "left")
        .join(org_name, "org_id", "left")
        .withColumns(
            {
                "kind": F.coalesce("new_kind", "kind"),
                "review_status": F.when(F.col("new_kind").isNotNull(), "USER_CONFIRMED").otherwise(F.col("review_status")),
                "official_job_id": F.when(~F.coalesce(dropped, F.lit(False)), F.col("official_job_id")),
                "canonical_key": F.when(
                    dropped,
                    F.concat_ws(":", F.lit("campaign"), F.coalesce("normalized_name", F.col("org_id").cast("string")), F.col("entity_id").cast("string")),
                ).otherwise(F.col("canonical_key")),
            }
        )
        .select(*entities.columns)
    )
    old = moved.select("entity_id", F.col("old_kind").alias("_old"))
    attempts = (
        fact_join(state["attempts"], old, ["entity_id"])
        .withColumn("scope", F.when(F.col("scope") == F.col("_old"), "UNKNOWN").otherwise(F.col("scope")))
        .select(*state["attempts"].columns)
    )
    ids = moved.select("entity_id")
    links = state["links"].join(ids.withColumnRenamed("entity_id", "campaign_id"), "campaign_id", "left_anti").join(
        ids.withColumnRenamed("entity_id", "posting_id"), "posting_id", "left_anti"
    ).select(*state["links"].columns)
    shortlist = state["shortlist"].join(to_campaign.select("entity_id"), "entity_id", "left_anti").select(
        *state["shortlist"].columns
    )
    claims = retire_claims(
        state["claims"], to_campaign.select("entity_id", F.lit("retired_with_reclassification").alias("reason"))
    )
    changed = {
        **state, "entities": new_entities, "attempts": attempts, "links": links, "shortlist": shortlist, "claims": claims,
    }
    return refresh_entities(changed, ids), judged.filter("error is not null").select("entity_id", "error")


def merge_plan(entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, rejected) of reviewed merges.

    merges: left_id, right_id. Chains are closed; a closed component with two kinds, organizations
    or posting ids is rejected whole. plan: entity_id, root, job_id; the smallest id is kept.
    """
    known = entities.select("entity_id").distinct()
    apart = merges.filter("left_id <> right_id").select("left_id", "right_id")
    left = apart.join(known.withColumnRenamed("entity_id", "left_id"), "left_id", "left_semi")
    right = apart.join(known.withColumnRenamed("entity_id", "right_id"), "right_id", "left_semi")
    joined = contract(left.join(known.withColumnRenamed("entity_id", "right_id"), "right_id", "left_semi"))
    # An entity whose partners are all unknown stays as it is.
    named = left.select(F.col("left_id").alias("node")).unionByName(right.select(F.col("right_id").alias("node"))).distinct()
    roots = fact_join(named, joined, ["node"]).withColumn("root", F.coalesce("root", "node"))
    members = roots.join(entities, roots["node"] == entities["entity_id"]).select(
        "entity_id", "root", "kind", "org_id", F.nullif("official_job_id", F.lit("")).alias("job")
    )
    facts = members.groupBy("root").agg(
        *[F.min(c).alias(f"{c}_lo") for c in ("kind", "org_id", "job")],
        *[F.max(c).alias(f"{c}_hi") for c in ("kind", "org_id", "job")],
    )
    facts = facts.select(
        "root",
        F.when(F.col("job_lo") != F.col("job_hi"), "different_ids")
        .when(F.col("kind_lo") != F.col("kind_hi"), "different_kinds")
        .when(~F.col("org_id_lo").eqNullSafe(F.col("org_id_hi")), "different_organizations")
        .alias("error"),
        F.col("job_lo").alias("job_id"),
    )
    judged = fact_join(members.select("entity_id", "root"), facts, ["root"], "inner")
    return (
        judged.filter("error is null").select("entity_id", "root", "job_id"),
        judged.filter("error is not null").select("entity_id", "root", "error"),
    )


def _remap(df: DataFrame, plan: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows moved to the kept entity, with `_moved`."""
    mapping = plan.select(F.col("entity_id").alias(column), F.col("root").alias("_root"))
    joined = fact_join(df, mapping, [column])
    moved = F.coalesce(F.col("_root") != F.col(column), F.lit(False))
    return joined.withColumn("_moved", moved).withColumn(column, F.coalesce("_root", column)).drop("_root")


def merge_notes(notes: Column, separator: str = "；") -> Column:
    """Join texts in order, leaving out those already contained."""
    return F.aggregate(
        notes,
        F.lit(""),
        lambda acc, x: F.when((x == "") | acc.contains(x), acc)
        .when(acc == "", x)
        .otherwise(F.concat(acc, F.lit(separator), x)),
    )


def apply_merges(state: State, merges: DataFrame) -> tuple[State, DataFrame]:
    """Move everything of merged entities to the one that stays; shells remain as MERGED."""
    plan, rejected = merge_plan(state["entities"], merges)
    plan = checkpoint(plan)
    entities = (
        state["entities"]
        .join(plan, "entity_id", "left")
        .withColumns(
            {
                "review_status": F.when(
                    F.coalesce(F.col("root") != F.col("entity_id"), F.lit(False)), "MERGED"
                ).otherwise(F.col("review_status")),
                "official_job_id": F.when(F.col("root") == F.col("entity_id"), F.coalesce(F.nullif("official_job_id", F.lit("")), "job_id")).otherwise(F.col("official_job_id")),
            }
        )
        .select(*state["entities"].columns)
    )
    origins = _remap(state["origins"], plan).drop("_moved").dropDuplicates(["entity_id", "raw_id"])
    claims = _remap(state["claims"], plan).drop("_moved")
    attempts = _remap(state["attempts"], plan).drop("_moved")
    decisions = _remap(state["decisions"], plan)
    decisions = decisions.withColumn("is_current", F.col("is_current") & ~F.col("_moved")).drop("_moved")
    links = _remap(_remap(state["links"], plan, "campaign_id").drop("_moved"), plan, "posting_id").drop("_moved")
    # Of the links that now join one pair the surest stays.
    rest = sorted((c for c in links.columns if c not in ("campaign_id", "posting_id")), key=lambda c: c != "confidence")
    if rest:
        links = links.groupBy("campaign_id", "posting_id").agg(F.max(F.struct(*rest)).alias("l")).select(
            *[F.col(c) if c in ("campaign_id", "posting_id") else F.col(f"l.{c}") for c in links.columns]
        )
    else:
        links = links.distinct()
    # The kept entry comes first; the note list is at most one line per merged shell.
    entries = _remap(state["shortlist"], plan)
    order = F.struct("_moved", "added_at")
    extra = [c for c in state["shortlist"].columns if c not in ("entity_id", "priority", "note", "added_at")]
    held = entries.groupBy("entity_id").agg(
        F.max("priority").alias("priority"),
        F.array_sort(F.collect_list(F.struct("_moved", "added_at", F.coalesce("note", F.lit("")).alias("note")))).alias("_notes"),
        F.min_by("added_at", order).alias("added_at"),
        *[F.min_by(c, order).alias(c) for c in extra],
    )
    shortlist = held.withColumn("note", merge_notes(F.transform("_notes", lambda x: x["note"]))).select(
        *state["shortlist"].columns
    )
    moved = {
        **state, "entities": entities, "origins": origins, "claims": claims, "attempts": attempts,
        "decisions": decisions, "links": links, "shortlist": shortlist,
    }
    return refresh_entities(moved, plan.select(F.col("root").alias("entity_id"))), rejected
