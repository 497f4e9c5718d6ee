"""Row kind: does a row describe a campaign or one posting, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.text import clean_text, has_any, let, split_values
from accordant.functions.url import is_direct_url, is_plausible_id

CAMPAIGN, POSTING = "CAMPAIGN", "POSTING"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def role_counts(title: Column, rules: R.KindRules = R.KindRules()) -> Column:
    """struct<roles, families, signals, categories> of a title."""
    cleaned = clean_text(title)
    return F.struct(
        F.greatest(
            F.size(split_values(title, rules.separators)),
            _count(F.coalesce(title, F.lit("")), rules.counted_suffixes),
        ).alias("roles"),
        _count(cleaned, rules.family_pattern).alias("families"),
        _count(cleaned, rules.role_signals).alias("signals"),
        _count(cleaned, rules.category_signals).alias("categories"),
    )


def classify_record(
    title: Column,
    cities: Column,
    apply_url: Column,
    announcement_url: Column,
    record_id: Column,
    rules: R.KindRules = R.KindRules(),
    id_rules: R.IdRules = R.IdRules(),
    normalized: bool = False,
) -> Column:
    """struct<kind, confidence, reasons, needs_review>; reasons are stable codes.

    `normalized` says that the links went through normalize_url already.
    """
    link = F.coalesce(F.nullif(apply_url, F.lit("")), announcement_url)
    facts = F.struct(
        clean_text(title).alias("title"),
        role_counts(clean_text(title), rules).alias("n"),
        is_direct_url(link, record_id, id_rules, normalized).alias("direct"),
        F.coalesce(is_plausible_id(record_id, id_rules), F.lit(False)).alias("has_id"),
        F.array_compact(
            F.array(
                *[
                    F.when(F.lower(clean_text(title)).contains(m.lower()), F.lit(m))
                    for m in rules.broad_markers
                ]
            )
        ).alias("broad"),
    )

    def outcome(kind: str, confidence: Column | float, reasons: Column, review: Column | bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
            reasons.alias("reasons"),
            (F.lit(review) if isinstance(review, bool) else review).alias("needs_review"),
        )

    def codes(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    def ladder(f: Column) -> Column:
        text, n, direct, broad = f["title"], f["n"], f["direct"], f["broad"]
        specific = has_any(text, rules.role_suffixes)
        unit = text.endswith(rules.unit_suffix)
        is_campaign = (
            (F.size(broad) > 0)
            | (n["roles"] >= 3)
            | (n["families"] >= 3)
            | ((F.length(text) >= 32) & (n["signals"] >= 4))
            | (n["categories"] >= 4)
            | unit
        )
        why = F.array_compact(
            F.array(
                F.when(
                    F.size(broad) > 0,
                    F.concat(F.lit("broad_marker:"), F.array_join(F.slice(broad, 1, 3), "、")),
                ),
                F.when(n["roles"] >= 3, F.concat(F.lit("roles:"), n["roles"].cast("string")))
                .when(n["families"] >= 3, F.concat(F.lit("role_families:"), n["families"].cast("string")))
                .when(n["signals"] >= 3, F.concat(F.lit("role_signals:"), n["signals"].cast("string")))
                .when(n["categories"] >= 4, F.concat(F.lit("categories:"), n["categories"].cast("string")))
                .when(unit, F.lit("unit_title")),
            )
        )
        return (
            F.when(
                f["has_id"] & specific & (n["roles"] <= 2),
                outcome(POSTING, 0.98, codes("record_id", "specific_title"), False),
            )
            .when(
                is_campaign,
                outcome(
                    CAMPAIGN, F.when(direct, F.lit(0.82)).otherwise(F.lit(0.94)), why, direct
                ),
            )
            .when(
                direct & (text != "") & specific,
                outcome(POSTING, 0.9, codes("direct_url", "specific_title"), False),
            )
            .when(
                (F.size(cities) > 2) & ~direct,
                outcome(CAMPAIGN, 0.78, codes("many_cities_without_direct_url"), True),
            )
            .otherwise(outcome(POSTING, 0.58, codes("no_stable_identity"), True))
        )

    return let(facts, ladder)


def present_title(
    title: Column, kind: Column, industry: Column, rules: R.TitleRules = R.TitleRules()
) -> Column:
    """struct<title, source_title, inferred, reason>; postings keep their own title."""
    trim = "^[%s]+|[%s]+$" % (rules.trim_chars, rules.trim_chars)
    cleaned = F.regexp_replace(
        F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "), trim, ""
    )

    def shown(text: Column) -> Column:
        context = F.concat(F.coalesce(industry, F.lit("")), F.lit(" "), text)
        repeats = F.greatest(*[_count(text, word) for word in rules.repeated])
        broad = (
            (_count(text, rules.family_pattern) >= rules.min_families)
            | (repeats >= rules.min_repeats)
            | (_count(text, rules.separator_pattern) >= rules.min_separators)
            | (F.length(text) >= rules.long_title)
        )

        def result(label: Column, inferred: bool, reason: str) -> Column:
            return F.struct(
                label.alias("title"),
                text.alias("source_title"),
                F.lit(inferred).alias("inferred"),
                F.lit(reason).alias("reason"),
            )

        chain = F.when(kind == POSTING, result(text, False, ""))
        for label, pattern in rules.industries:
            chain = chain.when(
                broad & context.rlike(pattern), result(F.lit(label), True, "broad_campaign_industry")
            )
        for label, pattern in rules.roles:
            chain = chain.when(text.rlike(pattern), result(F.lit(label), True, "role_keyword"))
        for label, pattern in rules.industries:
            chain = chain.when(context.rlike(pattern), result(F.lit(label), True, "industry"))
        return chain.otherwise(result(F.lit(rules.default), True, "default_direction"))

    return let(cleaned, shown)
