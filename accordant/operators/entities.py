"""Organizations, entity matching, lineage and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.classify import CAMPAIGN, POSTING
from accordant.functions.text import title_key
from accordant.functions.url import normalize_url
from accordant.operators.graph import connect
from accordant.session import fact_join, first_per_group


def _id(prefix: str, *parts: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), *parts), 256), 1, 32)


def resolve_orgs(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """One line per normalized name: the organization its rows belong to.

    rows: normalized_name, company, host, ordinal. orgs: org_id, canonical_name, normalized_name,
    candidate_domain, official_domain. An imported row never carries a trusted domain, so it takes
    the organization without one, else the only one of that name, else a new one. The first seen
    name is kept; a blank candidate domain is filled from the first row that has one.
    """
    seen = rows.groupBy("normalized_name").agg(
        F.min(F.struct("ordinal", "company")).alias("first"),
        F.min(F.when(F.col("host") != "", F.struct("ordinal", "host"))).alias("with_host"),
    )
    entry = F.struct("org_id", "canonical_name", "candidate_domain")
    known = orgs.groupBy("normalized_name").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("official_domain") == "", entry)).alias("open"),
        F.min(entry).alias("any"),
    )
    target = F.coalesce(F.col("open"), F.when(F.col("n") == 1, F.col("any")))
    return (
        seen.join(known, "normalized_name", "left")
        .withColumn("t", target)
        .select(
            "normalized_name",
            F.coalesce("t.org_id", _id("org", "normalized_name")).alias("org_id"),
            F.coalesce("t.canonical_name", "first.company").alias("canonical_name"),
            F.coalesce(F.nullif("t.candidate_domain", F.lit("")), "with_host.host", F.lit("")).alias(
                "candidate_domain"
            ),
            F.col("t").isNull().alias("is_new"),
        )
    )


def unlinked(raw: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows without an entity yet."""
    return raw.join(origins.select("raw_id").distinct(), "raw_id", "left_anti")


def canonical_key(rec: Column, kind: Column, needs_review: Column, source_id: Column, org_name: Column) -> Column:
    """Posting id, else trusted link, else the supplier's record id, else null."""
    link = normalize_url(F.coalesce(F.nullif(rec["apply_url"], F.lit("")), rec["announcement_url"]))
    posting = kind == POSTING
    return F.coalesce(
        F.when(
            posting & (F.coalesce(rec["official_job_id"], F.lit("")) != ""),
            F.concat(F.lit("official-job:"), org_name, F.lit(":"), F.lower(rec["official_job_id"])),
        ),
        F.when(posting & ~needs_review & (link != ""), F.concat(F.lit("official-url:"), link)),
        F.when(
            F.coalesce(rec["source_record_id"], F.lit("")) != "",
            F.concat(F.lit("source-record:"), source_id, F.lit(":"), rec["source_record_id"]),
        ),
    )


def _keys(kind: Column, org: Column, job: Column, link: Column, title: Column, source: Column, record: Column, explicit: Column) -> Column:
    """Lookup keys in rule order: id, id with title, link with title, supplier record."""

    def key(tag: str, *parts: Column) -> Column:
        return F.concat_ws("\u0001", F.lit(tag), *parts)

    has_job = (kind == POSTING) & (F.coalesce(job, F.lit("")) != "")
    return F.array_compact(
        F.array(
            F.when(has_job & explicit, F.struct(F.lit(1).alias("rule"), key("id", org, kind, F.lower(job)).alias("key"))),
            F.when(has_job & ~explicit, F.struct(F.lit(1).alias("rule"), key("id-title", org, kind, F.lower(job), title).alias("key"))),
            F.when(link.startswith("official-url:"), F.struct(F.lit(2).alias("rule"), key("link", org, kind, link, title).alias("key"))),
            F.when(F.coalesce(record, F.lit("")) != "", F.struct(F.lit(3).alias("rule"), key("record", source, record).alias("key"))),
        )
    )


def entity_keys(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Lookup index over known entities: one line per key, the earliest entity wins.

    entities: entity_id, org_id, kind, title, official_job_id, canonical_key, created_at.
    records: entity_id, source_id, source_record_id of stable supplier rows already linked.
    """
    held = F.struct("created_at", "entity_id", "org_id", "kind", "official_job_id").alias("e")
    blank = F.lit("")
    base = entities.select(
        "entity_id", "org_id", "kind", "official_job_id", "canonical_key", "created_at",
        title_key(F.col("title")).alias("title_key"),
    )
    common = (F.col("kind"), F.col("org_id"), F.col("official_job_id"))
    by_id = base.select(
        held,
        F.explode(_keys(*common, blank, F.col("title_key"), blank, blank, F.lit(True))).alias("k"),
    )
    by_id_title = base.select(
        held,
        F.explode(
            _keys(*common, F.coalesce("canonical_key", blank), F.col("title_key"), blank, blank, F.lit(False))
        ).alias("k"),
    )
    by_record = fact_join(records, base, ["entity_id"], "inner").select(
        held,
        F.explode(
            _keys(F.lit(CAMPAIGN), F.col("org_id"), F.lit(None).cast("string"), blank, blank,
                  F.col("source_id"), F.col("source_record_id"), F.lit(False))
        ).alias("k"),
    )
    every = by_id.unionByName(by_id_title).unionByName(by_record)
    return every.select(F.col("k.key").alias("key"), "e").groupBy("key").agg(F.min("e").alias("e"))


def match_entities(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, new): rows that belong to a known entity, and rows grouped into new ones.

    rows: raw_id, ordinal, org_id, kind, title, official_job_id, has_explicit_id, canonical_key,
    source_id, source_record_id. Rules apply in order: posting id (with an equal title unless the
    id was given explicitly), trusted link with an equal title, supplier record of the same
    organization and kind without a different id. Rows left over are grouped by the same keys;
    a group with several ids is split by id, rows without one follow its first id.
    """
    probe = rows.withColumn("title_key", title_key(F.col("title"))).withColumn(
        "has_explicit_id", F.coalesce("has_explicit_id", F.lit(False))
    )
    keys = _keys(
        F.col("kind"), F.col("org_id"), F.col("official_job_id"), F.coalesce("canonical_key", F.lit("")),
        F.col("title_key"), F.col("source_id"), F.col("source_record_id"), F.col("has_explicit_id"),
    )
    wanted = probe.select(
        "raw_id", "org_id", "kind", "official_job_id", F.explode(keys).alias("k")
    ).select("raw_id", "org_id", "kind", "official_job_id", "k.rule", "k.key")
    hits = fact_join(wanted, index, ["key"], "inner")
    clash = (
        (F.coalesce("official_job_id", F.lit("")) != "")
        & (F.coalesce("e.official_job_id", F.lit("")) != "")
        & (F.col("official_job_id") != F.col("e.official_job_id"))
    )
    valid = (F.col("rule") < 3) | (
        (F.col("e.org_id") == F.col("org_id")) & (F.col("e.kind") == F.col("kind")) & ~clash
    )
    best = (
        hits.filter(valid)
        .groupBy("raw_id")
        .agg(F.min(F.struct("rule", F.col("e.created_at").alias("created_at"), F.col("e.entity_id").alias("entity_id"), F.col("e.official_job_id").alias("held_id"))).alias("m"))
    )
    matched = probe.join(best, "raw_id").select(
        "raw_id",
        F.col("m.entity_id").alias("entity_id"),
        F.col("m.rule").alias("rule"),
        # A supplier-record match adopts the id the entity lacks.
        F.when(
            (F.col("m.rule") == 3) & (F.coalesce("m.held_id", F.lit("")) == ""), F.col("official_job_id")
        ).alias("adopted_id"),
        F.when(
            (F.col("m.rule") == 3) & (F.coalesce("m.held_id", F.lit("")) == "")
            & (F.coalesce("official_job_id", F.lit("")) != ""),
            F.col("canonical_key"),
        ).alias("adopted_key"),
    )
    rest = probe.join(best.select("raw_id"), "raw_id", "left_anti")
    return matched, group_new(rest)


def group_new(rows: DataFrame) -> DataFrame:
    """Unmatched rows with the id of the entity they found: raw_id, entity_id, is_first."""
    record = F.concat_ws("\u0001", "org_id", "kind", "source_record_id")
    args = (F.col("kind"), F.col("org_id"), F.col("official_job_id"), F.coalesce("canonical_key", F.lit("")),
            F.col("title_key"), F.col("source_id"), F.when(F.col("source_record_id").isNotNull(), record))
    # An explicit row also offers its id together with its title, so that rows with a derived id
    # and the same title find it.
    both = F.concat(
        _keys(*args, F.lit(False)),
        F.when(F.col("has_explicit_id"), _keys(*args, F.lit(True))).otherwise(F.array().cast("array<struct<rule:int,key:string>>")),
    )
    node = F.struct("ordinal", "raw_id")
    held = rows.withColumn("node", node)
    roots = connect(held.select("node", F.explode(both).alias("k")).select("node", F.col("k.key").alias("key")))
    placed = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    job = F.when(F.col("kind") == POSTING, F.nullif(F.lower("official_job_id"), F.lit("")))
    placed = placed.withColumn("job", job)
    first_job = placed.filter("job is not null").groupBy("root").agg(F.min_by("job", "node").alias("first_job"))
    sub = fact_join(placed, first_job, ["root"]).withColumn(
        "sub", F.coalesce("job", "first_job", F.lit(""))
    )
    lead = sub.groupBy("root", "sub").agg(F.min("node").alias("lead"))
    return fact_join(sub, lead, ["root", "sub"], "inner").select(
        "raw_id",
        _id("entity", F.col("lead.raw_id").cast("string")).alias("entity_id"),
        (F.col("node") == F.col("lead")).alias("is_first"),
    )


def create_entities(grouped: DataFrame, rows: DataFrame, created_at: Column) -> DataFrame:
    """New entities from the first row of every group."""
    job = F.when(F.col("kind") == POSTING, F.col("official_job_id"))
    weak = F.col("strength").isin("COMPOUND_HINT", "NONE") | F.col("needs_review")
    return (
        grouped.filter("is_first")
        .join(rows, "raw_id")
        .select(
            "entity_id", "org_id", "kind", "title", "canonical_key",
            job.alias("official_job_id"),
            F.when(weak, "REVIEW").otherwise("PENDING").alias("review_status"),
            created_at.alias("created_at"),
            created_at.alias("updated_at"),
        )
    )


def link_origins(pairs: DataFrame, origins: DataFrame) -> DataFrame:
    """Origins with the new pairs added once."""
    fresh = pairs.select("entity_id", "raw_id").distinct()
    return origins.unionByName(fresh.join(origins, ["entity_id", "raw_id"], "left_anti"))


def lineage(
    entities: DataFrame, origins: DataFrame, raw: DataFrame, batches: DataFrame, sources: DataFrame
) -> DataFrame:
    """entity -> origin -> raw -> batch -> source, with the row's kind beside the entity's."""
    registry = batches.join(sources, "source_id").select(
        "batch_id", "source_id", F.col("name").alias("source_name"), "independence_group", "snapshot_at",
        "imported_at",
    )
    linked = origins.join(raw.select("raw_id", "batch_id", F.col("kind").alias("raw_kind")), "raw_id")
    placed = fact_join(linked, registry, ["batch_id"], "inner")
    return fact_join(placed, entities.select("entity_id", "kind"), ["entity_id"], "inner").withColumn(
        "seen_at", F.coalesce("snapshot_at", "imported_at")
    )


def lineage_counts(lines: DataFrame) -> DataFrame:
    """Observations and distinct independence groups per entity; only rows of its kind count."""
    same = F.col("raw_kind") == F.col("kind")
    # Grouping by group first keeps the distinct count small for an entity with very many rows.
    per_group = lines.groupBy("entity_id", "independence_group").agg(
        F.count("*").alias("n"),
        F.max(same).alias("counts"),
        F.max(F.when(same, F.col("seen_at"))).alias("seen_at"),
    )
    return per_group.groupBy("entity_id").agg(
        F.sum("n").alias("observation_count"),
        F.count_if("counts").alias("source_count"),
        F.max("seen_at").alias("latest_seen_at"),
    )


def link_children(
    links: DataFrame, entities: DataFrame, existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) campaign-posting links.

    links: campaign_id, posting_id, evidence, confidence. Accepted links replace an older line for
    the same pair.
    """
    side = entities.select("entity_id", "kind", "org_id")
    parent = side.select(
        F.col("entity_id").alias("campaign_id"), F.col("kind").alias("pk"), F.col("org_id").alias("po")
    )
    child = side.select(
        F.col("entity_id").alias("posting_id"), F.col("kind").alias("ck"), F.col("org_id").alias("co")
    )
    judged = fact_join(fact_join(links, parent, ["campaign_id"]), child, ["posting_id"]).withColumn(
        "error",
        F.when(F.col("pk").isNull() | F.col("ck").isNull(), "not_found")
        .when(F.col("pk") != CAMPAIGN, "parent_not_campaign")
        .when(F.col("ck") != POSTING, "child_not_posting")
        .when(~F.col("po").eqNullSafe(F.col("co")), "other_organization"),
    )
    pair = ["campaign_id", "posting_id"]
    rejected = judged.filter("error is not null").select(*pair, "error")
    good = (
        judged.filter("error is null")
        .select(*pair, "evidence", "confidence")
        .groupBy(*pair)
        .agg(F.max(F.struct("confidence", "evidence")).alias("v"))
        .select(*pair, "v.evidence", "v.confidence", F.lit(True).alias("confirmed"))
    )
    if existing is not None:
        good = good.unionByName(existing.join(good, pair, "left_anti").select(*good.columns))
    return good, rejected
