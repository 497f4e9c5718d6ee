"""Official checks: evidence rules, recorded attempts, their claims, and the effective attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import CAMPAIGN, POSTING
from accordant.functions.text import let, list_key, strip_text
from accordant.functions.times import moment
from accordant.functions.url import (
    bare_host, id_matches_url, is_aggregator, is_direct_url, normalize_url, scope_matches,
)
from accordant.session import fact_join

CONCLUSIVE = ("OPEN", "CLOSED")


def with_anchor(rows: DataFrame, entities: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows with the entity's kind and id (`_kind`, `_job`) and its trust anchor (`_domain`, `_path`)."""
    trusted = F.coalesce(F.col("domain_verified"), F.lit(False))
    anchors = entities.join(orgs, "org_id", "left").select(
        "entity_id",
        F.col("kind").alias("_kind"),
        F.coalesce("official_job_id", F.lit("")).alias("_job"),
        F.when(
            trusted, F.regexp_replace(F.regexp_replace(F.lower("official_domain"), r"\.+$", ""), r"^www\.", "")
        ).otherwise("").alias("_domain"),
        F.when(trusted, F.coalesce("scope_path", F.lit(""))).otherwise("").alias("_path"),
    )
    return fact_join(rows, anchors, ["entity_id"])


def _evidence_error(url: Column, scope_rules: R.ScopeRules, id_rules: R.IdRules) -> Column:
    excerpt = F.length(strip_text(F.col("excerpt")))
    conclusive = F.col("result").isin(*CONCLUSIVE)
    posting = conclusive & (F.col("_kind") == POSTING)
    return (
        F.when(F.col("_kind").isNull(), "not_found")
        .when(url == "", "bad_url")
        .when(is_aggregator(bare_host(url), scope_rules), "aggregator")
        .when(F.col("_domain") == "", "domain_unknown")
        .when(~scope_matches(url, F.col("_domain"), F.col("_path"), scope_rules), "outside_scope")
        .when(conclusive & (excerpt < R.MIN_EXCERPT_CHARS), "excerpt_too_short")
        .when(posting & (F.col("_job") == ""), "posting_id_missing")
        .when(posting & ~is_direct_url(url, F.col("_job"), id_rules, normalized=True), "url_does_not_match_id")
    )


def validate_evidence(
    attempts: DataFrame,
    entities: DataFrame,
    orgs: DataFrame,
    scope_rules: R.ScopeRules = R.ScopeRules(),
    id_rules: R.IdRules = R.IdRules(),
) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) attempts; ok ones carry their canonical URL and anchor.

    attempts: verification_id, entity_id, result, url, final_url, checked_at, excerpt, fields
    (map of name to list; a text is a list of one).
    """
    url = normalize_url(F.coalesce(F.nullif("final_url", F.lit("")), "url"))
    # One expression holds both, so that a filter on the error does not repeat the normalisation.
    verdict = let(
        url,
        lambda u: F.struct(u.alias("canonical_url"), _evidence_error(u, scope_rules, id_rules).alias("error")),
    )
    judged = with_anchor(attempts, entities, orgs).withColumn("_v", verdict)
    ok = judged.filter("_v.error is null").withColumn("canonical_url", F.col("_v.canonical_url")).drop("_v")
    rejected = judged.filter("_v.error is not null").select("verification_id", "entity_id", F.col("_v.error").alias("error"))
    return ok, rejected


def sanitize_fields(
    attempts: DataFrame, allowed: Sequence[str] = R.REVIEWABLE_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): unknown fields reject the attempt; values are trimmed to their limits."""
    unknown = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*[F.lit(a) for a in allowed])))
    lists = F.array(*[F.lit(f) for f in R.LIST_FIELDS])
    many = F.map_filter("fields", lambda k, v: ~F.array_contains(lists, k) & (F.size(v) > 1))
    judged = attempts.withColumn("fields", F.coalesce("fields", F.expr("cast(map() as map<string, array<string>>)")))
    judged = judged.withColumn(
        "error",
        F.when(F.size(unknown) > 0, F.concat(F.lit("unsupported_fields:"), F.array_join(unknown, ",")))
        .when(F.size(many) > 0, F.concat(F.lit("not_text:"), F.array_join(F.array_sort(F.map_keys(many)), ","))),
    )

    def clean(k: Column, v: Column) -> Column:
        items = F.filter(
            F.transform(F.slice(v, 1, R.REVIEW_LIST_ITEMS), strip_text), lambda x: x != ""
        )
        short = F.transform(items, lambda x: F.substring(x, 1, R.REVIEW_ITEM_CHARS))
        text = F.transform(v, lambda x: F.substring(strip_text(x), 1, R.REVIEW_TEXT_CHARS))
        return F.when(F.array_contains(lists, k), short).otherwise(text)

    given = F.map_filter("fields", lambda _, v: (F.size(v) > 0) & (F.coalesce(F.get(v, F.lit(0)), F.lit("")) != ""))
    ok = judged.filter("error is null").drop("error").withColumn("fields", F.transform_values(given, clean))
    return ok, judged.filter("error is not null").select("verification_id", "entity_id", "error")


def record_attempts(ok: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(attempt lines, rejected) of validated attempts: bound to kind, domain and path of today."""
    limit = moment(as_of) + F.make_dt_interval(mins=F.lit(R.CLOCK_TOLERANCE_MINUTES))
    conclusive = F.col("result").isin(*CONCLUSIVE)
    given = F.coalesce(F.size(F.map_keys("fields")), F.lit(0)) > 0
    judged = ok.withColumn("checked_at", F.coalesce("checked_at", moment(as_of))).withColumn(
        "error",
        F.when(~conclusive & given, "fields_need_conclusive_result").when(
            F.col("checked_at") > limit, "checked_in_future"
        ),
    )
    clean, bad_fields = sanitize_fields(judged.filter("error is null").drop("error"))
    rejected = judged.filter("error is not null").select("verification_id", "entity_id", "error")
    none = F.expr("cast(map() as map<string, array<string>>)")
    status = F.when(conclusive, F.create_map(F.lit("status"), F.array("result"))).otherwise(none)
    link = F.when(
        conclusive & (F.col("_kind") == POSTING), F.create_map(F.lit("apply_url"), F.array("canonical_url"))
    ).otherwise(none)
    excerpt = strip_text(F.col("excerpt"))
    lines = clean.select(
        "verification_id", "entity_id", "result",
        F.col("_kind").alias("scope"),
        F.col("_domain").alias("domain"),
        F.col("_path").alias("scope_path"),
        normalize_url(F.col("url")).alias("url"),
        normalize_url(F.col("final_url")).alias("final_url"),
        "checked_at",
        moment(as_of).alias("created_at"),
        excerpt.alias("excerpt"),
        F.when(excerpt != "", F.sha2(excerpt, 256)).otherwise("").alias("content_hash"),
        F.map_concat("fields", status, link).alias("fields"),
    )
    return lines, rejected.unionByName(bad_fields)


def attempt_claims(attempts: DataFrame) -> DataFrame:
    """Claims of recorded attempts: official authority, one per allowed field."""
    allowed = [*R.REVIEWABLE_FIELDS, "status", "apply_url"]
    lists = F.col("field").isin(*R.LIST_FIELDS)
    value = F.when(lists, list_key(F.col("value"))).otherwise(F.coalesce(F.get("value", F.lit(0)), F.lit("")))
    return (
        attempts.select("*", F.explode("fields").alias("field", "value"))
        .filter(F.col("field").isin(*allowed))
        .withColumn("raw_value", value)
        .filter("raw_value <> ''")
        .select(
            "entity_id",
            F.lit(None).cast("string").alias("raw_id"),
            "verification_id",
            F.when(F.col("scope") == CAMPAIGN, R.AUTHORITY_OFFICIAL_CAMPAIGN)
            .otherwise(R.AUTHORITY_OFFICIAL_POSTING)
            .alias("authority"),
            F.col("checked_at").alias("observed_at"),
            "created_at",
            F.concat_ws(":", F.lit("verification"), "scope", "domain").alias("source_key"),
            F.lit("manual-verification").alias("evidence_label"),
            F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("evidence_url"),
            F.lit("manual-verification").alias("parser"),
            F.lit(True).alias("active"),
            "field",
            "raw_value",
            F.col("raw_value").alias("value_key"),
            F.lit(1.0).alias("confidence"),
            F.concat_ws(":", "verification_id", "field").alias("claim_id"),
        )
    )


def in_scope_attempts(
    attempts: DataFrame, entities: DataFrame, orgs: DataFrame, check_path: bool = True
) -> DataFrame:
    """Attempts still bound to the entity's kind and trust anchor, with `_kind` and `_job`."""
    joined = with_anchor(attempts, entities, orgs)
    same = (F.col("_domain") != "") & (F.col("scope") == F.col("_kind")) & (F.col("domain") == F.col("_domain"))
    if check_path:
        same = same & (F.coalesce("scope_path", F.lit("")) == F.col("_path"))
    return joined.filter(same)


LATEST = ("checked_at", "created_at", "verification_id")


def latest_attempt(scoped: DataFrame) -> DataFrame:
    """The newest attempt per entity; ties fall to creation, then id."""
    return (
        scoped.groupBy("entity_id")
        .agg(F.max(F.struct(*LATEST, "result")).alias("v"))
        .select("entity_id", "v.verification_id", "v.result", "v.checked_at")
    )


def effective_attempt(
    attempts: DataFrame, entities: DataFrame, orgs: DataFrame, id_rules: R.IdRules = R.IdRules()
) -> DataFrame:
    """The attempt that speaks for an entity: in scope and, for a posting, at its own id."""
    scoped = in_scope_attempts(attempts, entities, orgs)
    link = F.coalesce(F.nullif("final_url", F.lit("")), "url")
    own = (F.col("_kind") != POSTING) | ((F.col("_job") != "") & id_matches_url(link, F.col("_job"), id_rules))
    return latest_attempt(scoped.filter(own))


def fresh_open(scoped: DataFrame, as_of: str, max_age_days: float) -> DataFrame:
    """Per entity whether any scoped attempt is fresh, and whether a fresh one is OPEN."""
    from accordant.functions.times import within

    return scoped.groupBy("entity_id").agg(
        F.max(within(F.col("checked_at"), as_of, max_age_days)).alias("has_fresh"),
        F.max(within(F.col("checked_at"), as_of, max_age_days) & (F.col("result") == "OPEN")).alias("has_fresh_open"),
    )


def validate_identity_url(
    commands: DataFrame,
    entities: DataFrame,
    orgs: DataFrame,
    scope_rules: R.ScopeRules = R.ScopeRules(),
    id_rules: R.IdRules = R.IdRules(),
) -> DataFrame:
    """Commands (entity_id, url, official_job_id) with `canonical_url` and `error`."""

    def judge(url: Column) -> Column:
        error = (
            F.when(F.col("_kind").isNull(), "not_found")
            .when(is_aggregator(bare_host(url), scope_rules), "aggregator")
            .when(F.col("_domain") == "", "domain_unknown")
            .when(~scope_matches(url, F.col("_domain"), F.col("_path"), scope_rules), "outside_scope")
            .when(
                ~id_matches_url(url, F.col("official_job_id"), id_rules, normalized=True), "url_does_not_match_id"
            )
        )
        return F.struct(url.alias("canonical_url"), error.alias("error"))

    judged = with_anchor(commands, entities, orgs).withColumn("_v", let(normalize_url(F.col("url")), judge))
    return judged.select("*", "_v.canonical_url", "_v.error").drop("_v")
