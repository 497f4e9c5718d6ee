"""Profile facts: span-exact extraction, curation, versions, preferences and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.text import contains_term, extract_years, fact_label, fold_category, line_spans, strip_text
from accordant.session import fact_join, first_per_group

KINDS = ("GRADUATION_YEAR", "EDUCATION", "SKILL", "EXPERIENCE", "PROJECT")


def doc_lines(docs: DataFrame, text: str = "text", bullet_chars: str = R.FactRules.bullet_chars) -> DataFrame:
    """Non-empty lines with half-open offsets into the text. No shuffle: each text stays in place."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.explode(line_spans(F.col(text), bullet_chars)).alias("l")).select(
        *kept, F.col("l.start").alias("start"), F.col("l.end").alias("end"), F.col("l.evidence").alias("evidence")
    )


def line_facts(evidence: Column, rules: R.FactRules = R.FactRules()) -> Column:
    """array<struct<kind, value>> of one line."""

    def fact(kind: str, value: Column, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    found = []
    if rules.graduation:
        years = [F.nullif(F.regexp_extract(evidence, p, 1), F.lit("")) for p in rules.graduation]
        year = F.coalesce(*years)
        found.append(fact("GRADUATION_YEAR", F.concat(year, F.lit(rules.graduation_suffix)), year.isNotNull()))
    found += [fact("EDUCATION", F.lit(label), evidence.rlike(p)) for label, p in rules.education]
    found += [fact("SKILL", F.lit(label), evidence.rlike(p)) for label, p in rules.skills]
    told = F.length(evidence) >= rules.min_story_length
    if rules.project:
        found.append(
            fact("PROJECT", fact_label(evidence, rules.project_fallback, rules), told & evidence.rlike(rules.project))
        )
    if rules.experience:
        found.append(
            fact(
                "EXPERIENCE", fact_label(evidence, rules.experience_fallback, rules),
                told & evidence.rlike(rules.experience),
            )
        )
    return F.array_compact(F.array(*found))


def extract_facts(lines: DataFrame, rules: R.FactRules = R.FactRules()) -> DataFrame:
    """Facts of every line with their evidence and span."""
    return lines.select("*", F.explode(line_facts(F.col("evidence"), rules)).alias("f")).select(
        *lines.columns, "f.kind", "f.value"
    )


def fact_id(source: Column, start: Column, end: Column, kind: Column, value: Column) -> Column:
    parts = F.concat_ws(":", source, start.cast("string"), end.cast("string"), kind, value)
    return F.concat(F.lit("fact_"), F.substring(F.sha2(parts, 256), 1, 16))


def fact_ids(facts: DataFrame, source: str, keys: Sequence[str] = ()) -> DataFrame:
    """Facts with ids. Repeats of kind, value and span collapse; the id is only a label."""
    named = facts.withColumn(
        "fact_id", fact_id(F.col(source), F.col("start"), F.col("end"), F.col("kind"), F.col("value"))
    )
    return named.dropDuplicates([*keys, source, "kind", "value", "start", "end"]) if keys else named


def profile_facts(docs: DataFrame, rules: R.FactRules = R.FactRules()) -> DataFrame:
    """Unconfirmed facts of profile texts. docs: profile_id, name, text.

    One line yields each kind and value once (the rule labels are distinct and a line has one
    project and one experience label), and lines do not overlap, so nothing needs de-duplicating.
    """
    facts = fact_ids(extract_facts(doc_lines(docs.select("profile_id", "name", "text")), rules), "name")
    return facts.select(
        "fact_id", "profile_id", "kind", "value", "evidence", "start", "end",
        F.lit("resume").alias("provenance"),
        F.lit(False).alias("confirmed"),
    )


def extraction_warnings(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Profiles from which nothing could be extracted."""
    return docs.join(facts.select("profile_id").distinct(), "profile_id", "left_anti").select(
        "profile_id", F.lit("no_facts_extracted").alias("warning")
    )


def curate_facts(facts: DataFrame, commands: DataFrame, rules: R.FactRules = R.FactRules()) -> DataFrame:
    """Confirm or correct facts. commands: fact_id, at, new_confirmed, new_value (nulls keep).

    A corrected value is its own evidence: the text says so and the span covers it.
    """
    last = commands.groupBy("fact_id").agg(
        F.max(F.when(F.col("new_value").isNotNull(), F.struct("at", "new_value"))).alias("v"),
        F.max(F.when(F.col("new_confirmed").isNotNull(), F.struct("at", "new_confirmed"))).alias("c"),
    )
    joined = fact_join(facts, last, ["fact_id"])
    value = F.col("v.new_value")
    changed = value.isNotNull() & (value != F.col("value"))
    text = F.concat(F.lit(rules.correction_prefix), value)
    return joined.select(
        *[c for c in facts.columns if c not in ("value", "evidence", "start", "end", "provenance", "confirmed")],
        F.coalesce(value, F.col("value")).alias("value"),
        F.when(changed, text).otherwise(F.col("evidence")).alias("evidence"),
        F.when(changed, F.lit(0)).otherwise(F.col("start")).alias("start"),
        F.when(changed, F.length(text)).otherwise(F.col("end")).alias("end"),
        F.when(changed, F.lit("user_correction")).otherwise(F.col("provenance")).alias("provenance"),
        F.coalesce(F.col("c.new_confirmed"), F.col("confirmed")).alias("confirmed"),
    ).select(*facts.columns)


def active_profiles(uploads: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Profile versions of every owner with the one that is active.

    uploads: owner, name, content_hash, at. The same text under the same name is one version;
    uploading or activating it again makes it the active one.
    """
    versions = uploads.groupBy(owner, "name", "content_hash").agg(
        F.min("at").alias("created_at"), F.max("at").alias("activated_at")
    )
    version = F.struct("activated_at", "name", "content_hash")
    last = versions.groupBy(owner).agg(F.max(version).alias("_last"))
    return fact_join(versions, last, [owner], "inner").withColumn("is_active", version == F.col("_last")).drop("_last")


def upsert_preferences(prefs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(preferences, owners whose decisions are stale). Only cities and types make them stale."""
    key = ["profile_id", "key"]
    columns = ["value", "hard_constraint", "confirmed", "at"]
    both = prefs.select(*key, *columns).unionByName(commands.select(*key, *columns))
    latest = both.groupBy(*key).agg(F.max(F.struct("at", "value", "hard_constraint", "confirmed")).alias("v"))
    stale = (
        commands.filter(F.col("key").isin("accepted_cities", "accepted_recruitment_types"))
        .select("profile_id")
        .distinct()
    )
    return latest.select(*key, *[f"v.{c}" for c in columns]), stale


def load_profiles(
    facts: DataFrame, prefs: DataFrame, rules: R.DecisionRules = R.DecisionRules()
) -> DataFrame:
    """One line per profile with everything the decision needs.

    facts: fact_id, profile_id, kind, value, evidence, start, end, confirmed. prefs: profile_id,
    key, value (array), hard_constraint, confirmed. Facts without a span or of an unknown kind are
    ignored; cities and types count only as hard constraints. A profile is one text, so its arrays
    are no larger than that text.
    """
    valid = facts.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("kind").isin(*KINDS))
    sure = F.col("confirmed")

    def member(kind: str, c: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(sure & (F.col("kind") == kind), c)))

    text = F.concat_ws(" ", "value", "evidence")
    useful = sure & F.col("kind").isin(*rules.fit_kinds)
    tag_columns = []
    for i, label in enumerate(sorted(rules.dictionary)):
        hit = F.lit(False)
        for term in rules.dictionary[label]:
            hit = hit | contains_term(text, term)
        tag_columns.append(
            F.array_sort(F.collect_set(F.when(useful & hit, F.struct("fact_id", "start", "end")))).alias(f"_t{i}")
        )
    stamp = F.concat_ws("|", "fact_id", "kind", "value", F.col("confirmed").cast("string"))
    base = valid.groupBy("profile_id").agg(
        member("GRADUATION_YEAR", F.col("value")).alias("_years"),
        member("GRADUATION_YEAR", F.col("fact_id")).alias("year_refs"),
        member("EDUCATION", F.col("value")).alias("education"),
        member("EDUCATION", F.col("fact_id")).alias("education_refs"),
        F.max(useful).alias("has_evidence"),
        F.array_sort(F.collect_set(stamp)).alias("_facts"),
        *tag_columns,
    )
    tags = F.map_from_arrays(
        F.array(*[F.lit(label) for label in sorted(rules.dictionary)]),
        F.array(*[F.col(f"_t{i}") for i in range(len(rules.dictionary))]),
    )
    base = base.select(
        "profile_id",
        extract_years(F.col("_years"), rules.year_pattern).alias("years"),
        "year_refs", "education", "education_refs", "has_evidence",
        F.map_filter(tags, lambda _, v: F.size(v) > 0).alias("tags"),
        F.sha2(F.to_json("_facts"), 256).alias("facts_hash"),
    )
    hard = prefs.filter(
        "confirmed and (hard_constraint or key not in ('accepted_cities', 'accepted_recruitment_types'))"
    )

    def preference(name: str, each=strip_text) -> Column:
        values = F.max(F.when(F.col("key") == name, F.col("value")))
        kept = F.filter(F.transform(values, each), lambda x: x != "")
        return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))

    wishes = hard.groupBy("profile_id").agg(
        preference("accepted_cities").alias("accepted_cities"),
        preference(
            "accepted_recruitment_types", lambda x: fold_category(x, rules.type_folding)
        ).alias("accepted_types"),
        preference("target_role_keywords").alias("target_keywords"),
    )
    empty = F.array().cast("array<string>")
    joined = base.join(wishes, "profile_id", "full_outer")
    return joined.select(
        "profile_id",
        *[
            F.coalesce(c, empty).alias(c)
            for c in ("years", "year_refs", "education", "education_refs", "accepted_cities", "accepted_types", "target_keywords")
        ],
        F.coalesce("has_evidence", F.lit(False)).alias("has_evidence"),
        "tags",
        F.coalesce("facts_hash", F.lit("")).alias("facts_hash"),
    )


def representative_evidence(
    facts: DataFrame, refs: DataFrame, k: int = 3, rules: R.DecisionRules = R.DecisionRules()
) -> DataFrame:
    """Per decision the k best excerpts, one per span and text.

    refs: entity_id, fact_id. Better: experience over project over skill, specific over generic
    values, longer evidence up to 160 characters, earlier in the text.
    """
    rank = (
        F.when(F.col("kind") == "EXPERIENCE", 3).when(F.col("kind") == "PROJECT", 2).when(F.col("kind") == "SKILL", 1).otherwise(0)
    )
    order = [
        rank.desc(),
        F.col("value").isin(*rules.generic_values).asc(),
        F.least(F.length("evidence"), F.lit(160)).desc(),
        F.col("start").asc(),
        F.col("fact_id").asc(),
    ]
    joined = fact_join(refs.select("entity_id", "fact_id").distinct(), facts, ["fact_id"], "inner")
    texts = joined.withColumn("_text", F.trim("evidence"))
    best = first_per_group(texts, ["entity_id", "start", "end", "_text"], order)
    return first_per_group(best, ["entity_id"], order, k).select(
        "entity_id", "fact_id", "kind", "value", "evidence", "start", "end"
    )


def erase_profiles(state: dict[str, DataFrame], owners: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Remove everything that belongs to the profiles, leaving one tombstone event each.

    Tables keyed by profile_id: profiles, facts, preferences, decisions. events: entity_type,
    entity_id, event_type, created_at, payload.
    """
    ids = owners.select("profile_id").distinct()
    out = dict(state)
    for name in ("profiles", "facts", "preferences", "decisions"):
        if name in state:
            out[name] = state[name].join(ids, "profile_id", "left_anti").select(*state[name].columns)
    if "events" in state:
        events = state["events"]
        personal = F.col("entity_type").isin("profile", "profile_fact", "preference")
        gone = ids.select(F.col("profile_id").cast("string").alias("entity_id"))
        kept = events.filter(~personal).unionByName(events.filter(personal).join(gone, "entity_id", "left_anti").select(*events.columns))
        tombstones = gone.select(
            F.lit("profile").alias("entity_type"), "entity_id", F.lit("PROFILE_DELETED").alias("event_type"),
            at.alias("created_at"), F.lit('{"decision_snapshots_removed":true}').alias("payload"),
        )
        out["events"] = kept.unionByName(tombstones.select(*events.columns))
    return out
