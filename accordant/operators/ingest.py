"""Supplier rows to canonical records: mapping, canonical projection, parse status, identity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.classify import classify_record
from accordant.functions.text import (
    any_of, canonical_json, clean_text, coerce_cell, header_key, let, normalize_company, split_values,
)
from accordant.functions.url import (
    extract_record_id, extract_url, is_plausible_id, normalize_url,
)

Aliases = Mapping[str, Sequence[str]]


class MappingError(ValueError):
    """A required field has no source column."""


def infer_mapping(header: Sequence[str], aliases: Aliases = R.FIELD_ALIASES) -> dict[str, str]:
    """Canonical field -> source column; the first alias in priority order wins."""
    by_key = {header_key(name): name for name in header}
    mapping = {}
    for field, names in aliases.items():
        hit = next((by_key[header_key(n)] for n in names if by_key.get(header_key(n))), None)
        if hit:
            mapping[field] = hit
    return mapping


def check_mapping(mapping: Mapping[str, str], required: Sequence[str] = ("company", "title")) -> list[str]:
    """Stable codes; `missing:*` is fatal, `positional_record_id` is only a flag."""
    problems = [f"missing:{field}" for field in required if not mapping.get(field)]
    if is_positional(mapping):
        problems.append("positional_record_id")
    return problems


def is_positional(mapping: Mapping[str, str]) -> bool:
    source = mapping.get("source_record_id")
    return bool(source) and header_key(source) in {header_key(h) for h in R.POSITIONAL_HEADERS}


def resolve_mapping(
    header: Sequence[str],
    aliases: Aliases = R.FIELD_ALIASES,
    override: Mapping[str, str] | None = None,
    required: Sequence[str] = ("company", "title"),
) -> dict[str, str]:
    mapping = {**infer_mapping(header, aliases), **(override or {})}
    fatal = [p for p in check_mapping(mapping, required) if p.startswith("missing:")]
    if fatal:
        raise MappingError("; ".join(fatal))
    return mapping


def pack_raw(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Move the source columns into one text map `raw`, as they came."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return rows.withColumn("raw", F.create_map(*pairs)).drop(*columns)


def map_columns(
    rows: DataFrame, mapping: Mapping[str, str], aliases: Aliases = R.FIELD_ALIASES, raw: str | None = None
) -> DataFrame:
    """One projection to canonical text columns; unmapped fields become ''."""
    types = dict(rows.dtypes)

    def cell(field: str) -> Column:
        source = mapping.get(field)
        if source is None:
            return F.lit("")
        if raw:
            return clean_text(F.try_element_at(F.col(raw), F.lit(source)))
        return coerce_cell(F.col(f"`{source}`"), types.get(source, "string"))

    kept = [c for c in rows.columns if raw or c not in set(mapping.values())]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[cell(f).alias(f) for f in aliases])


def canonicalize(rows: DataFrame, mapping: Mapping[str, str], id_rules: R.IdRules = R.IdRules()) -> DataFrame:
    """Canonical text columns to the record struct `rec`, plus `has_explicit_id`."""
    explicit = F.when(is_plausible_id(F.col("official_job_id"), id_rules), F.col("official_job_id"))
    positional = is_positional(mapping)
    typed = rows.withColumns(
        {
            "has_explicit_id": F.col("official_job_id") != "",
            "announcement_url": extract_url(F.col("announcement_url")),
            "apply_url": extract_url(F.col("apply_url")),
        }
    ).withColumn(
        "official_job_id",
        F.coalesce(
            explicit,
            extract_record_id(F.col("title"), F.col("announcement_url"), F.col("apply_url"), rules=id_rules),
        ),
    )

    def value(field: str) -> Column:
        if field in R.LIST_FIELDS:
            return split_values(F.col(field))
        if field == "source_record_id":
            return F.lit(None).cast("string") if positional else F.nullif(F.col(field), F.lit(""))
        return F.col(field)

    fields = list(R.FIELD_ALIASES)
    record = F.struct(*[value(f).alias(f) for f in fields])
    return typed.withColumn("rec", record).drop(*fields)


def parse_status(company: Column, title: Column) -> tuple[Column, Column]:
    """(status, errors): both required cells empty is a reject, one is partial."""
    errors = F.array_compact(
        F.array(F.when(company == "", F.lit("company_empty")), F.when(title == "", F.lit("title_empty")))
    )
    status = F.when(F.size(errors) == 2, "REJECTED").when(F.size(errors) == 1, "PARTIAL").otherwise("PARSED")
    return status, errors


def is_non_job_row(company: Column, markers: Sequence[str] = R.COPYRIGHT_MARKERS) -> Column:
    return (F.coalesce(company, F.lit("")) == "") | company.rlike(any_of(markers))


def row_hash(raw: Column) -> Column:
    """SHA-256 of the raw row in key order; cells are hashed as they came."""
    return F.sha2(canonical_json(raw), 256)


def compound_identity(
    company: Column, title: Column, cities: Column, recruitment_type: Column, years: Column
) -> Column:
    """Hash of company, title, cities, type and years; null without company or title."""

    def ordered(values: Column) -> Column:
        return F.array_sort(F.filter(F.transform(values, clean_text), lambda x: x != ""))

    parts = F.struct(
        ordered(cities).alias("cities"),
        normalize_company(company).alias("company"),
        ordered(years).alias("graduation_years"),
        F.lower(clean_text(recruitment_type)).alias("recruitment_type"),
        F.lower(clean_text(title)).alias("title"),
    )
    return let(
        parts,
        lambda p: F.when(
            (p["company"] != "") & (p["title"] != ""), F.substring(F.sha2(F.to_json(p), 256), 1, 32)
        ),
    )


def identity_hint(rec: Column, normalized: bool = False) -> Column:
    """struct<value, strength, stable, evidence>: the strongest identity a record offers."""
    link = F.coalesce(F.nullif(rec["apply_url"], F.lit("")), rec["announcement_url"])
    link = link if normalized else normalize_url(link)
    compound = compound_identity(
        rec["company"], rec["title"], rec["cities"], rec["recruitment_type"], rec["graduation_years"]
    )

    def hint(value: Column, strength: str, stable: bool, evidence: str) -> Column:
        return F.struct(
            value.cast("string").alias("value"),
            F.lit(strength).alias("strength"),
            F.lit(stable).alias("stable"),
            F.lit(evidence).alias("evidence"),
        )

    def ladder(found: Column) -> Column:
        return (
            F.when(
                F.coalesce(rec["source_record_id"], F.lit("")) != "",
                hint(rec["source_record_id"], "SOURCE_RECORD_ID", True, "supplier_record_id"),
            )
            .when(
                F.coalesce(rec["official_job_id"], F.lit("")) != "",
                hint(rec["official_job_id"], "OFFICIAL_JOB_ID", True, "posting_id"),
            )
            .when(found["u"] != "", hint(found["u"], "OFFICIAL_URL", True, "normalized_url"))
            .when(found["c"].isNotNull(), hint(found["c"], "COMPOUND_HINT", False, "review_only"))
            .otherwise(hint(F.lit(None), "NONE", False, "no_identity"))
        )

    return let(F.struct(link.alias("u"), compound.alias("c")), ladder)


def parse_rows(
    rows: DataFrame,
    mapping: Mapping[str, str],
    kind_rules: R.KindRules = R.KindRules(),
    id_rules: R.IdRules = R.IdRules(),
) -> DataFrame:
    """Rows with a `raw` map to the working form of raw records."""
    records = canonicalize(map_columns(rows, mapping, raw="raw"), mapping, id_rules)
    rec = F.col("rec")
    status, errors = parse_status(rec["company"], rec["title"])
    kind = classify_record(
        rec["title"], rec["cities"], rec["apply_url"], rec["announcement_url"], rec["official_job_id"],
        kind_rules, id_rules, normalized=True,
    )
    return (
        records.withColumns(
            {
                "row_hash": row_hash(F.col("raw")),
                "identity": identity_hint(rec, normalized=True),
                "_kind": kind,
                "parse_status": status,
                "parse_errors": errors,
                "raw": F.transform_values("raw", lambda _, v: clean_text(v)),
            }
        )
        .withColumns(
            {
                "kind": F.col("_kind.kind"),
                "kind_confidence": F.col("_kind.confidence"),
                "kind_reasons": F.col("_kind.reasons"),
                "needs_review": F.col("_kind.needs_review"),
            }
        )
        .drop("_kind")
    )


def rejected_rows(raw: DataFrame) -> DataFrame:
    return raw.filter("parse_status = 'REJECTED'").select("row_number", "parse_errors")


def preview(raw: DataFrame, sample: int = 10, rejects: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, first rows, first rejects) of a parsed snapshot."""
    non_job = is_non_job_row(F.col("rec.company"))
    shown = F.when(non_job, "NON_JOB").otherwise(F.col("kind"))
    totals = raw.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("parse_status") != "REJECTED").alias("success_count"),
        F.count_if(F.col("parse_status") == "REJECTED").alias("error_count"),
        *[F.count_if(shown == k).alias(k.lower()) for k in ("CAMPAIGN", "POSTING", "NON_JOB")],
    )
    first = raw.filter(F.col("row_number") <= sample).select(
        "row_number",
        "rec",
        shown.alias("kind"),
        F.when(non_job, F.lit(1.0)).otherwise(F.col("kind_confidence")).alias("confidence"),
        F.when(non_job, F.array(F.lit("non_job_row"))).otherwise(F.col("kind_reasons")).alias("reasons"),
        F.when(non_job, F.lit(False)).otherwise(F.col("needs_review")).alias("needs_review"),
        "parse_status",
        "parse_errors",
    )
    bad = rejected_rows(raw).orderBy("row_number").limit(rejects)
    return totals, first, bad


def is_importable(raw: DataFrame) -> Column:
    """Rows that may become entities: parsed, with company and title, no notice rows."""
    return (
        (F.col("parse_status") != "REJECTED")
        & (F.col("rec.title") != "")
        & ~is_non_job_row(F.col("rec.company"))
    )
