"""Field claims: unpivot, scope, and resolution by authority and recency.

Claims are dealt out by entity once, and all steps work inside it. Where every claim of a row has the same entity
(RowClaims), the rows are dealt out and their claims made behind the exchange. A field of one entity may hold any share of all
claims: entities with far more than their share are set apart (split_hot). Their winners and conflicts are maxima
and minima that combine before the shuffle, and claims meet them in joins that Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import POSTING
from accordant.functions.text import clean_text, is_missing, list_key, normalize_claim_list, normalize_company, title_key
from accordant.functions.times import within
from accordant.session import fact_join, split_hot

GROUP = ["entity_id", "field"]
SOURCE_GROUP = [*GROUP, "source_key"]
RECENCY = ["observed_at", "created_at", "claim_id"]
CLAIM_FIELDS = (
    "company", "title", "cities", "graduation_years", "education", "recruitment_type", "industry",
    "employer_type", "written_test", "published_at", "deadline", "status", "announcement_url", "apply_url",
)

# Reasons: stable codes.
ALL_MISSING = "all_missing"
SUPERSEDED = "superseded"
CONFLICT = "conflict"
UNRESOLVED_ABOVE = "higher_authority_unresolved"
SELECTED = "selected"
AGREES = "agrees"
OVERRIDDEN = "overridden"
HISTORICAL = "historical"


def authority(kind: Column, source_kind: Column, verified: Column) -> Column:
    """Only an official source of a verified domain ranks above an aggregator."""
    return F.when(
        (source_kind == "OFFICIAL") & F.coalesce(verified, F.lit(False)),
        F.when(kind == POSTING, R.AUTHORITY_OFFICIAL_POSTING).otherwise(R.AUTHORITY_OFFICIAL_CAMPAIGN),
    ).otherwise(R.AUTHORITY_AGGREGATOR)


def source_key(scope: Column, domain: Column, group: Column, parser: Column) -> Column:
    """Whose voice a claim is: a verified scope, an independence group, or a manual entry."""
    return (
        F.when(scope.isNotNull(), F.concat_ws(":", F.lit("verification"), scope, domain))
        .when(group.isNotNull(), F.concat_ws(":", F.lit("raw"), group))
        .otherwise(F.concat_ws(":", F.lit("manual"), parser))
    )


def unpivot_claims(rows: DataFrame, keep: Sequence[str | Column], fields: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One line per field: `fields` maps a field name to its (raw value, comparable value)."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("field"), raw.alias("raw_value"), key.alias("value_key"))
            for name, (raw, key) in fields.items()
        ]
    )
    return rows.select(*keep, F.explode(entries).alias("c")).select("*", "c.*").drop("c")


def to_claims(rows: DataFrame) -> DataFrame:
    """Claims of raw records.

    rows: raw_id, entity_id, entity_kind, rec, source_kind, domain_verified, independence_group,
    snapshot_at, imported_at, source_name, file_name, file_format, row_number.
    """
    rec = F.col("rec")

    def pair(name: str) -> tuple[Column, Column]:
        if name == "status":
            return F.lit("UNKNOWN"), F.lit("UNKNOWN")
        if name in R.LIST_FIELDS:
            return list_key(rec[name]), normalize_claim_list(rec[name])
        # The field is known here, and canonical records hold normalised links already.
        comparable = {"company": normalize_company, "title": title_key}.get(name)
        if comparable is None:
            comparable = (lambda c: c) if name in R.URL_FIELDS else clean_text
        return rec[name], comparable(rec[name])

    fields = {name: pair(name) for name in CLAIM_FIELDS}
    fields["official_job_id"] = (rec["official_job_id"], F.lower(rec["official_job_id"]))
    link = F.coalesce(F.nullif(rec["apply_url"], F.lit("")), rec["announcement_url"])
    keep = [
        "entity_id",
        "raw_id",
        F.lit(None).cast("string").alias("verification_id"),
        authority(F.col("entity_kind"), F.col("source_kind"), F.col("domain_verified")).alias("authority"),
        F.coalesce("snapshot_at", "imported_at").alias("observed_at"),
        F.col("imported_at").alias("created_at"),
        F.concat(F.lit("raw:"), "independence_group").alias("source_key"),
        F.concat_ws(
            " · ", "source_name", "file_name", F.concat(F.lit("row "), F.col("row_number").cast("string"))
        ).alias("evidence_label"),
        link.alias("evidence_url"),
        F.concat(F.lit("source-import/"), "file_format").alias("parser"),
        F.lit(True).alias("active"),
    ]
    claims = unpivot_claims(rows, keep, fields).filter("field <> 'official_job_id' or raw_value is not null")
    return claims.withColumns(
        {
            "confidence": F.when(F.col("field") == "status", F.lit(0.0)).otherwise(F.lit(1.0)),
            "claim_id": F.concat_ws(":", F.col("raw_id").cast("string"), "field"),
        }
    )


def _with_known(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A left join of the rows that have the key; the others have nothing to meet and stay where they are."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in facts.schema.fields if f.name != key}
    met = rows.filter(F.col(key).isNotNull()).join(facts, key, "left")
    return met.unionByName(rows.filter(F.col(key).isNull()).withColumns(none))


def applicable_claims(
    claims: DataFrame, raw: DataFrame, attempts: DataFrame, entities: DataFrame, orgs: DataFrame
) -> DataFrame:
    """Add `applicable`: active, and its evidence still has the entity's kind and trust anchor.

    Claims meet only the evidence they name. They meet the anchors by entity alone, so that steps that
    deal claims out by entity find them so; a hot entity is left to Spark's splitting of skewed joins.
    """
    trusted = F.coalesce(F.col("domain_verified"), F.lit(False))
    anchors = entities.join(orgs, "org_id", "left").select(
        "entity_id",
        F.col("kind").alias("_kind"),
        F.when(trusted, F.col("official_domain")).otherwise("").alias("_domain"),
        F.when(trusted, F.col("scope_path")).otherwise("").alias("_path"),
    )
    row_kind = raw.select("raw_id", F.col("kind").alias("_raw_kind"))
    checks = attempts.select(
        "verification_id", F.col("scope").alias("_scope"), F.col("domain").alias("_at"),
        F.col("scope_path").alias("_under"),
    )
    named = _with_known(_with_known(claims, row_kind, "raw_id"), checks, "verification_id")
    joined = named.join(anchors, "entity_id", "left")
    fits = (
        F.when(F.col("raw_id").isNotNull(), F.col("_raw_kind") == F.col("_kind"))
        .when(
            F.col("verification_id").isNotNull(),
            (F.col("_scope") == F.col("_kind")) & (F.col("_at") == F.col("_domain")) & (F.col("_under") == F.col("_path")),
        )
        .otherwise(F.col("_kind").isNotNull())
    )
    identity = (F.col("field") != "official_job_id") | (F.col("_kind") == POSTING)
    return joined.withColumn("applicable", F.coalesce(F.col("active") & identity & fits, F.lit(False))).select(
        *claims.columns, "applicable"
    )


def usable_claims(claims: DataFrame) -> DataFrame:
    """Claims that take part in resolution, with `_full` for those that say something."""
    kept = claims.filter("active") if "active" in claims.columns else claims
    if "applicable" in claims.columns:
        kept = kept.filter("applicable")
    return kept.withColumn("_full", ~is_missing(F.col("value_key")))


@dataclass(frozen=True)
class RowClaims:
    """Claims that are not made yet: `make` gives those of any of the rows, `per_row` at most, all with the row's `key` for entity."""

    rows: DataFrame
    key: str
    make: Callable[[DataFrame], DataFrame]
    per_row: int

    def made(self) -> DataFrame:
        return self.make(self.rows)

    def then(self, step: Callable[[DataFrame], DataFrame]) -> RowClaims:
        """The same claims after a step that works line by line and keeps entity_id."""
        return replace(self, make=lambda rows: step(self.make(rows)))

    def having(self, test: Column) -> RowClaims:
        """The claims of the rows that pass a test."""
        return replace(self, rows=self.rows.filter(test))

    def of(self, keys: DataFrame) -> RowClaims:
        """The claims of the entities in `keys` (entity_id)."""
        wanted = keys.select(F.col("entity_id").alias(self.key)).distinct()
        return replace(self, rows=self.rows.join(wanted, self.key, "left_semi"))


def by_entity(
    claims: DataFrame | RowClaims, usual: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame] | None = None,
    counted: DataFrame | None = None, floor: int = 100_000, **limits: int,
) -> DataFrame:
    """`usual` over claims dealt out by entity, and `hot` (else the same) over those of entities too large for a task."""
    if isinstance(claims, RowClaims):
        make = claims.make
        usual, hot = (lambda rows, step=usual: step(make(rows))), (lambda rows, step=hot or usual: step(make(rows)))
        dealt, large = split_hot(claims.rows, claims.key, floor=floor // claims.per_row, **limits)
    else:
        dealt, large = split_hot(claims, "entity_id", counted, floor, **limits)
    done = usual(dealt)
    return done if large is None else done.unionByName((hot or usual)(large))


def latest_per_source(claims: DataFrame | RowClaims, **limits: int) -> DataFrame:
    """The newest populated claim of every source: one line per entity, field and source."""
    return by_entity(_usable_rows(claims), _latest, counted=_counted(claims), **limits)


def _usable_rows(claims: DataFrame | RowClaims) -> DataFrame | RowClaims:
    return claims.then(usable_claims) if isinstance(claims, RowClaims) else usable_claims(claims)


def _counted(claims: DataFrame | RowClaims) -> DataFrame | None:
    """Rows of claims are counted themselves."""
    return None if isinstance(claims, RowClaims) else claims


def _latest(usable: DataFrame) -> DataFrame:
    entry = F.struct(*RECENCY, "authority", "value_key", "raw_value")
    return usable.groupBy(*SOURCE_GROUP).agg(
        F.max(F.when(F.col("_full"), entry)).alias("latest"), F.count_if("_full").alias("history")
    )


def verdicts(claims: DataFrame | RowClaims, **limits: int) -> DataFrame:
    """One line per entity and field: what is selected, or that it is in conflict or missing."""
    return by_entity(_usable_rows(claims), lambda part: _verdicts(_latest(part)), counted=_counted(claims), **limits)


def _verdicts(latest: DataFrame) -> DataFrame:
    t = F.col("latest")
    # Least and greatest value at the top authority differ exactly if top sources disagree.
    high = F.max(F.struct(t["authority"].alias("a"), t["value_key"].alias("v")))
    low = F.min(F.when(t.isNotNull(), F.struct((-t["authority"]).alias("a"), t["value_key"].alias("v"))))
    best = F.max(
        F.when(
            t.isNotNull(),
            F.struct(
                t["authority"].alias("authority"), *[t[c].alias(c) for c in RECENCY],
                t["value_key"].alias("value_key"), t["raw_value"].alias("raw_value"),
            ),
        )
    )
    facts = latest.groupBy(*GROUP).agg(
        best.alias("b"), high.alias("hi"), low.alias("lo"), F.count("latest").alias("sources")
    )
    conflict = F.col("hi.v") != F.col("lo.v")
    state = F.when(F.col("b").isNull(), "missing").when(conflict, "conflict").otherwise("selected")
    chosen = state == "selected"
    return facts.select(
        *GROUP,
        state.alias("state"),
        F.col("b.authority").alias("top_authority"),
        F.when(chosen, F.col("b.claim_id")).alias("selected_id"),
        F.when(chosen, F.col("b.value_key")).alias("selected_key"),
        F.when(chosen, F.col("b.raw_value")).alias("selected_value"),
        F.when(chosen, F.col("b.observed_at")).alias("selected_at"),
        "sources",
    )


def resolve_claims(claims: DataFrame | RowClaims, counted: DataFrame | None = None, **limits: int) -> DataFrame:
    """Every claim with `selected` and a `reason` code; inactive claims keep theirs.

    Claims cross one exchange, by entity, and see the newest claim of their source and the verdict of
    their group in windows. Entities too large for a task go the way of `_resolve_hot`. `counted`: rows
    with the same entity_id, or more, that cost less to count.
    """
    return by_entity(claims, _resolve, _resolve_hot, counted, **limits)


def _usable(columns: Sequence[str]) -> Column:
    flags = [F.col(c) for c in ("active", "applicable") if c in columns]
    return F.coalesce(reduce(lambda a, b: a & b, flags, F.lit(True)), F.lit(False))


def _resolve(claims: DataFrame) -> DataFrame:
    """Labels in windows over claims dealt out by entity: no further exchange, one sort."""
    source, group = Window.partitionBy(*SOURCE_GROUP), Window.partitionBy(*GROUP)
    usable = _usable(claims.columns)
    said = F.when(usable & ~is_missing(F.col("value_key")), F.struct(*RECENCY, "authority", "value_key"))
    t = F.col("_latest")
    top, low = F.col("_top"), F.col("_low")
    best = F.struct(t["authority"].alias("authority"), *[t[c].alias(c) for c in RECENCY], t["value_key"].alias("value_key"))
    judged = claims.withColumns({"_latest": F.max(said).over(source), "_usable": F.max(usable).over(source)}).withColumns(
        {
            "_top": F.max(F.when(t.isNotNull(), best)).over(group),
            # Least and greatest value at the top authority differ exactly if top sources disagree.
            "_high": F.max(F.when(t.isNotNull(), F.struct(t["authority"].alias("a"), t["value_key"].alias("v")))).over(group),
            "_low": F.min(F.when(t.isNotNull(), F.struct((-t["authority"]).alias("a"), t["value_key"].alias("v")))).over(group),
        }
    )
    # A source without a usable claim, or without a name, meets no verdict.
    known = F.col("_usable") & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in SOURCE_GROUP])
    state = F.when(top.isNull(), "missing").when(F.col("_high.v") != low["v"], "conflict").otherwise("selected")
    chosen = known & (F.col("state") == "selected")
    return _with_reason(
        judged.withColumn("state", F.when(known, state)).withColumns(
            {
                "_newest": F.coalesce(known & (F.col("claim_id") == t["claim_id"]), F.lit(False)),
                "top_authority": F.when(known, top["authority"]),
                "selected_id": F.when(chosen, top["claim_id"]),
                "selected_key": F.when(chosen, top["value_key"]),
            }
        ),
        claims.columns,
    )


def _resolve_hot(claims: DataFrame) -> DataFrame:
    """The newest claim of each source and the verdict over them are aggregates, and claims meet them
    in one join, so a group of any size costs a line per source and never fills a task. Both uses
    of the newest claims share one exchange: the input is read twice.
    """
    latest = _latest(usable_claims(claims))
    facts = fact_join(
        latest.select(*SOURCE_GROUP, F.col("latest.claim_id").alias("_latest")),
        _verdicts(latest).select(*GROUP, "state", "top_authority", "selected_id", "selected_key"),
        GROUP,
    )
    joined = fact_join(claims, facts, SOURCE_GROUP)
    newest = F.coalesce(F.col("claim_id") == F.col("_latest"), F.lit(False))
    return _with_reason(joined.withColumn("_newest", newest), claims.columns)


def _with_reason(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Labels from `_newest`, `state`, `top_authority`, `selected_id` and `selected_key`."""
    reason = (
        F.when(F.col("state") == "missing", ALL_MISSING)
        .when(is_missing(F.col("value_key")), "")
        .when(~F.col("_newest"), SUPERSEDED)
        .when(
            F.col("state") == "conflict",
            F.when(F.col("authority") == F.col("top_authority"), CONFLICT).otherwise(UNRESOLVED_ABOVE),
        )
        .when(F.col("claim_id") == F.col("selected_id"), SELECTED)
        .when(F.col("value_key") == F.col("selected_key"), AGREES)
        .when(F.col("authority") < F.col("top_authority"), OVERRIDDEN)
        .otherwise("")
    )
    if "applicable" in columns:
        reason = F.when(~F.col("applicable"), HISTORICAL).otherwise(reason)
    if "active" in columns:
        kept = F.col("reason") if "reason" in columns else F.lit("")
        reason = F.when(~F.col("active"), kept).otherwise(reason)
    out = judged.withColumn("_reason", reason)
    return out.select(
        *[c for c in columns if c not in ("selected", "reason")],
        (F.col("_reason") == SELECTED).alias("selected"),
        F.col("_reason").alias("reason"),
    )


def label_missing(claims: DataFrame) -> DataFrame:
    """Groups in which no usable claim says anything."""
    groups = usable_claims(claims).groupBy(*GROUP).agg(F.count_if("_full").alias("populated"), F.count("*").alias("claims"))
    return groups.filter("populated = 0").select(*GROUP, "claims", F.lit(ALL_MISSING).alias("reason"))


def refresh_claims(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Resolve again only the groups named in `keys` (entity_id, or entity_id and field)."""
    on = [c for c in GROUP if c in keys.columns]
    mark = keys.select(*on).distinct()
    again = resolve_claims(claims.join(mark, on, "left_semi"), counted=claims)
    rest = claims.join(mark, on, "left_anti")
    return rest.select(*claims.columns).unionByName(again.select(*claims.columns))


def fresh_values(claims: DataFrame, as_of: str, max_age_days: float) -> DataFrame:
    """Resolved claims to decision values: one line per entity and field.

    Imported and verified claims expire; manual ones do not. A field is in conflict if a fresh
    claim was in conflict; its value is the selected claim, else the unanimous top authority.
    """
    manual = F.col("raw_id").isNull() & F.col("verification_id").isNull()
    kept = usable_claims(claims).filter("_full").filter(
        manual | within(F.col("observed_at"), as_of, max_age_days)
    )
    entry = F.struct(F.col("authority"), *RECENCY, "value_key", "raw_value")
    facts = kept.groupBy(*GROUP).agg(
        F.max(F.when(F.col("selected"), entry)).alias("chosen"),
        F.max(entry).alias("top"),
        F.max(F.struct("authority", "value_key")).alias("hi"),
        F.min(F.struct((-F.col("authority")).alias("a"), "value_key")).alias("lo"),
        F.max(F.col("reason") == CONFLICT).alias("in_conflict"),
        F.max(F.when(F.col("raw_id").isNotNull(), F.col("observed_at"))).alias("raw_seen_at"),
    )
    unanimous = F.col("hi.value_key") == F.col("lo.value_key")
    value = F.coalesce(F.col("chosen"), F.when(unanimous, F.col("top")))
    return facts.withColumn("v", value).select(
        *GROUP, F.col("v.value_key").alias("value_key"), F.col("v.raw_value").alias("raw_value"),
        "in_conflict", "raw_seen_at",
    )


def pivot_values(values: DataFrame, fields: Sequence[str], value: str = "value_key") -> DataFrame:
    """One line per entity with a column per listed field; absent fields are ''."""
    return values.groupBy("entity_id").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col(value))), F.lit("")).alias(f) for f in fields]
    )


def field_facts(claims: DataFrame, raw_fields: Sequence[str] = ("company", "title")) -> DataFrame:
    """All a view needs per entity and field: shown value, conflicts, differences, selection."""
    kept = usable_claims(claims)
    shown = F.when(F.col("field").isin(*raw_fields), F.col("raw_value")).otherwise(F.col("value_key"))
    full = F.col("_full")
    entry = F.struct("authority", *RECENCY, shown.alias("shown"), "value_key", "raw_value")
    key = F.when(full, F.col("value_key"))
    facts = kept.groupBy(*GROUP).agg(
        F.max(F.when(F.col("selected"), entry)).alias("chosen"),
        F.max(F.when(full, entry)).alias("top"),
        F.min(key).alias("least"),
        F.max(key).alias("most"),
        F.max(F.when(full, F.struct("authority", "value_key"))).alias("hi"),
        F.min(F.when(full, F.struct((-F.col("authority")).alias("a"), "value_key"))).alias("lo"),
        F.max(F.col("reason") == CONFLICT).alias("in_conflict"),
    )
    split = F.col("chosen").isNull() & F.coalesce(F.col("hi.value_key") != F.col("lo.value_key"), F.lit(False))
    return facts.select(
        *GROUP,
        F.when(~split, F.coalesce("chosen.shown", "top.shown")).alias("value"),
        split.alias("conflict"),
        F.coalesce(F.col("least") != F.col("most"), F.lit(False)).alias("differs"),
        F.col("chosen.value_key").alias("selected_key"),
        F.col("chosen.raw_value").alias("selected_raw"),
        "in_conflict",
    )


def display_values(claims: DataFrame, raw_fields: Sequence[str] = ("company", "title")) -> DataFrame:
    """Shown value per entity and field, with conflict and difference flags.

    Without a selected claim the top authority's newest value is shown unless it disagrees.
    """
    return field_facts(claims, raw_fields).select(*GROUP, "value", "conflict", "differs")


def display_counts(display: DataFrame) -> DataFrame:
    return display.groupBy("entity_id").agg(
        F.count_if("conflict").alias("conflict_count"),
        F.count_if("differs").alias("historical_difference_count"),
    )


def best_value(claims: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field the selected claim's value, else the newest."""
    entry = F.struct("selected", "observed_at", "claim_id", "value_key")
    return (
        claims.filter(F.col("field").isin(*fields))
        .groupBy(*GROUP)
        .agg(F.max(entry).alias("b"))
        .select(*GROUP, F.col("b.value_key").alias("value_key"))
    )


def refresh_titles(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities shown under their selected title claim."""
    title = (
        claims.filter("field = 'title' and selected")
        .groupBy("entity_id")
        .agg(F.max_by(clean_text(F.col("raw_value")), F.col("claim_id")).alias("_title"))
    )
    return entities.join(title, "entity_id", "left").withColumn(
        "title", F.coalesce(F.nullif("_title", F.lit("")), "title")
    ).drop("_title")


def retire_claims(claims: DataFrame, commands: DataFrame) -> DataFrame:
    """Switch off manual posting-id claims of entities that were re-identified or reclassified.

    commands: entity_id, reason. A claim made by the same command is newer than `at`, if given.
    """
    order = F.struct("at", "reason") if "at" in commands.columns else F.struct("reason")
    last = commands.groupBy("entity_id").agg(F.max(order).alias("_cmd"))
    joined = fact_join(claims, last, ["entity_id"])
    manual = (
        F.col("raw_id").isNull() & F.col("verification_id").isNull()
        & (F.col("field") == "official_job_id") & F.col("active")
    )
    hit = manual & F.col("_cmd").isNotNull()
    if "at" in commands.columns:
        hit = hit & (F.col("created_at") < F.col("_cmd.at"))
    return joined.withColumns(
        {
            "reason": F.when(hit, F.col("_cmd.reason")).otherwise(F.col("reason")),
            "selected": F.when(hit, F.lit(False)).otherwise(F.col("selected")),
            "active": F.when(hit, F.lit(False)).otherwise(F.col("active")),
        }
    ).select(*claims.columns)


def claim_matrix(claims: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All claims with what a reviewer sees beside them, one line per claim.

    Order for display: entity_id, field, authority desc, observed_at desc. The matrix stays long
    so that an entity with very many claims is never one value. `names`: raw_id, source_name.
    """
    shown = claims.withColumn("selected", F.col("selected") & F.col("applicable"))
    if names is not None:
        shown = shown.join(names.select("raw_id", "source_name"), "raw_id", "left")
        shown = shown.withColumn("source_name", F.coalesce("source_name", F.lit("")))
    else:
        shown = shown.withColumn("source_name", F.lit(""))
    return shown.select(
        "entity_id", "field", "authority", "observed_at", "claim_id", "raw_value", "value_key",
        "applicable", "selected", "reason", "source_name",
    )
