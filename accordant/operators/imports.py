"""One batch from parsed rows to entities, claims and duplicate candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import normalize_company
from accordant.functions.url import record_host
from accordant.operators.claims import resolve_claims, to_claims, applicable_claims
from accordant.operators.entities import (
    canonical_key, create_entities, entity_keys, link_origins, match_entities, resolve_orgs, unlinked,
)
from accordant.operators.decisions import invalidate
from accordant.operators.ingest import is_importable
from accordant.operators.pairs import candidate_pairs
from accordant.session import checkpoint, fact_join

State = dict[str, DataFrame]

SCHEMAS = {
    "orgs": "org_id string, canonical_name string, normalized_name string, candidate_domain string, official_domain string, scope_path string, domain_verified boolean",
    "entities": "entity_id string, org_id string, kind string, title string, canonical_key string, official_job_id string, review_status string, created_at timestamp, updated_at timestamp",
    "origins": "entity_id string, raw_id string",
    "claims": "claim_id string, entity_id string, raw_id string, verification_id string, field string, raw_value string, value_key string, authority int, observed_at timestamp, created_at timestamp, source_key string, evidence_label string, evidence_url string, parser string, confidence double, active boolean, selected boolean, reason string",
    "attempts": "verification_id string, entity_id string, result string, scope string, domain string, scope_path string, url string, final_url string, checked_at timestamp, created_at timestamp, excerpt string, content_hash string, fields map<string, array<string>>",
    "decisions": "decision_id string, entity_id string, profile_id string, eligibility string, evidence_fit string, trust string, fingerprint string, is_current boolean, manual string, override_reason string, created_at timestamp",
    "links": "campaign_id string, posting_id string, evidence string, confidence double, confirmed boolean",
    "shortlist": "entity_id string, priority int, note string, stage string, next_action string, next_action_at timestamp, applied_at timestamp, added_at timestamp",
}


def empty_state(spark) -> State:
    """Working tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def raw_id(batch_id: Column, row_number: Column) -> Column:
    return F.concat_ws(":", batch_id, row_number.cast("string"))


def materialize(state: State, parsed: DataFrame, batch: DataFrame, source: DataFrame) -> tuple[State, DataFrame]:
    """(state, per-row outcome) after one or more batches of one load.

    parsed: parse_rows output with batch_id. batch: batch_id, source_id, file_name, file_format,
    snapshot_at, imported_at. source: source_id, name, kind, independence_group. Rows are matched
    against entities as they were before the load and then among themselves; titles shown in the
    view follow the selected claim afterwards.
    """
    registry = batch.join(source.withColumnsRenamed({"name": "source_name", "kind": "source_kind"}), "source_id")
    rows = parsed.withColumn("raw_id", raw_id(F.col("batch_id"), F.col("row_number")))
    # Parsing is by far the widest projection; it runs once.
    raw_line = checkpoint(
        rows.select(
            "raw_id", "batch_id", "row_number", "kind", "needs_review", "identity", "parse_status", "rec", "has_explicit_id"
        )
    )
    known_raw = state.get("raw")
    raw = raw_line if known_raw is None else known_raw.unionByName(raw_line.join(known_raw.select("raw_id"), "raw_id", "left_anti"))
    fresh = fact_join(unlinked(raw_line.filter(is_importable(raw_line)), state["origins"]), registry, ["batch_id"], "inner")
    rec = F.col("rec")
    fresh = fresh.withColumns(
        {
            "normalized_name": normalize_company(rec["company"]),
            "company": rec["company"],
            "title": rec["title"],
            "host": record_host(rec["apply_url"], rec["announcement_url"]),
            "ordinal": F.struct("imported_at", "batch_id", "row_number"),
            "official_job_id": rec["official_job_id"],
            "source_record_id": rec["source_record_id"],
            "strength": F.col("identity.strength"),
        }
    )
    fresh = checkpoint(fresh)
    resolved = checkpoint(resolve_orgs(fresh, state["orgs"]))
    named = fact_join(fresh, resolved.select("normalized_name", "org_id"), ["normalized_name"], "inner").withColumn(
        "canonical_key", canonical_key(rec, F.col("kind"), F.col("needs_review"), F.col("source_id"), F.col("normalized_name"))
    )
    named = checkpoint(named)
    held = state["orgs"].join(resolved.select("org_id", F.col("candidate_domain").alias("_host")), "org_id", "left")
    orgs = held.withColumn("candidate_domain", F.coalesce("_host", "candidate_domain")).drop("_host").unionByName(
        resolved.filter("is_new").select(
            "org_id", "canonical_name", "normalized_name", "candidate_domain", F.lit("").alias("official_domain"),
            F.lit("").alias("scope_path"), F.lit(False).alias("domain_verified"),
        )
    )
    stable = raw.filter("identity.stable and rec.source_record_id is not null").join(state["origins"], "raw_id")
    all_batches = registry if "batches" not in state else state["batches"].select("batch_id", "source_id").unionByName(
        registry.select("batch_id", "source_id")
    ).distinct()
    records = fact_join(stable, all_batches.select("batch_id", "source_id"), ["batch_id"], "inner").select(
        "entity_id", "source_id", F.col("rec.source_record_id").alias("source_record_id")
    )
    matched, grouped = match_entities(named, checkpoint(entity_keys(state["entities"], records)))
    matched, grouped = checkpoint(matched), checkpoint(grouped)
    created = create_entities(grouped, named, F.col("imported_at"))
    adopted = (
        matched.filter("adopted_id is not null")
        .groupBy("entity_id")
        .agg(F.min(F.struct("raw_id", "adopted_id", "adopted_key")).alias("a"))
    )
    kept = state["entities"].join(adopted, "entity_id", "left").withColumns(
        {
            "official_job_id": F.coalesce("official_job_id", "a.adopted_id"),
            "canonical_key": F.coalesce("a.adopted_key", "canonical_key"),
        }
    ).drop("a")
    entities = checkpoint(kept.unionByName(created.select(*kept.columns)))
    pairs = matched.select("entity_id", "raw_id").unionByName(grouped.select("entity_id", "raw_id"))
    origins = link_origins(pairs, state["origins"])
    origins, orgs = checkpoint(origins), checkpoint(orgs)
    anchor = entities.join(orgs.select("org_id", "domain_verified"), "org_id", "left").select(
        "entity_id", F.col("kind").alias("entity_kind"), "domain_verified"
    )
    observed = fact_join(named.join(pairs, "raw_id"), anchor, ["entity_id"], "inner")
    new_claims = to_claims(observed).withColumns({"selected": F.lit(False), "reason": F.lit("")})
    claims = state["claims"].unionByName(new_claims.select(*state["claims"].columns))
    touched = pairs.select("entity_id").distinct().withColumn("_touched", F.lit(True))
    marked = fact_join(claims, touched, ["entity_id"])
    scoped = applicable_claims(marked.filter("_touched").drop("_touched"), raw, state["attempts"], entities, orgs)
    columns = state["claims"].columns
    claims = checkpoint(
        marked.filter("_touched is null").select(*columns).unionByName(resolve_claims(scoped, counted=claims).select(*columns))
    )
    moved = {
        **state, "raw": raw, "orgs": orgs, "entities": entities, "origins": origins, "claims": claims,
        "batches": all_batches.select("batch_id", "source_id"),
        "decisions": invalidate(state["decisions"], matched),
    }
    outcome = matched.select("raw_id", "entity_id", F.lit("reused").alias("outcome")).unionByName(
        grouped.select("raw_id", "entity_id", F.when(F.col("is_first"), "created").otherwise("reused").alias("outcome"))
    )
    return moved, outcome


def duplicate_candidates(state: State, new_weak: DataFrame) -> DataFrame:
    """Candidates between the given new, weakly identified entities and their organization.

    new_weak: entity_id, identity_hint. Values are the entities' selected claims.
    """
    from accordant.operators.claims import best_value

    values = best_value(state["claims"], ("title", "cities", "graduation_years", "recruitment_type"))
    pivot = values.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value_key"))).alias(f"_{f}") for f in ("title", "cities", "graduation_years", "recruitment_type")]
    )
    empty = F.array().cast("array<string>")

    def items(name: str) -> Column:
        return F.coalesce(F.from_json(F.nullif(F.col(name), F.lit("")), "array<string>"), empty)

    known = state["entities"].filter("review_status <> 'MERGED'").join(pivot, "entity_id", "left").join(
        new_weak.withColumn("_new", F.lit(True)), "entity_id", "left"
    )
    return candidate_pairs(
        known.select(
            "entity_id", "org_id", "kind", F.coalesce("_title", "title").alias("title"), items("_cities").alias("cities"),
            items("_graduation_years").alias("graduation_years"), F.coalesce("_recruitment_type", F.lit("")).alias("recruitment_type"),
            F.nullif("official_job_id", F.lit("")).alias("official_job_id"), "identity_hint",
            F.coalesce("_new", F.lit(False)).alias("is_new_weak"),
        )
    )
