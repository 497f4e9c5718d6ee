"""Snapshots of a source: diff, fingerprints, and the guards in front of the batch store."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import clean_set, strip_text
from accordant.functions.times import moment
from accordant.rules import CLOCK_TOLERANCE_MINUTES, LIST_FIELDS

CHANGES = ("ADDED", "MODIFIED", "MISSING", "UNCHANGED")


def require_unique(rows: DataFrame, keys: Sequence[str], what: str = "record id") -> None:
    """Refuse rows whose key is missing or repeated."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = rows.groupBy(*keys).count().filter((F.col("count") > 1) | missing).take(1)
    if bad:
        raise ValueError(f"{what} missing or repeated: {bad[0].asDict()}")


def snapshot_diff(
    previous: DataFrame | None, current: DataFrame, key: str, hash_col: str, checked: bool = True
) -> DataFrame:
    """Change per record between two snapshots: (key, change, previous_hash, current_hash).

    Both sides hold one line per key, so the full outer join has no hot keys. Without a previous
    snapshot everything is ADDED.
    """
    if checked:
        require_unique(current, [key])
    now = current.select(F.col(key), F.col(hash_col).alias("current_hash"))
    if previous is None:
        return now.select(key, F.lit("ADDED").alias("change"), F.lit("").alias("previous_hash"), "current_hash")
    before = previous.select(F.col(key), F.col(hash_col).alias("previous_hash"))
    change = (
        F.when(F.col("previous_hash").isNull(), "ADDED")
        .when(F.col("current_hash").isNull(), "MISSING")
        .when(F.col("previous_hash") == F.col("current_hash"), "UNCHANGED")
        .otherwise("MODIFIED")
    )
    return before.join(now, key, "full_outer").select(
        key,
        change.alias("change"),
        F.coalesce("previous_hash", F.lit("")).alias("previous_hash"),
        F.coalesce("current_hash", F.lit("")).alias("current_hash"),
    )


def diff_counts(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return diff.groupBy(*by).agg(
        *[F.count_if(F.col("change") == c).alias(f"{c.lower()}_count") for c in CHANGES]
    )


def multiset_fingerprint(df: DataFrame, group: Sequence[str], hash_col: Column | str) -> DataFrame:
    """Order-insensitive fingerprint of a multiset of texts per group.

    Each member contributes the four 64-bit words of its SHA-256; words are summed, so the state
    is constant, combines before the shuffle and never gathers a group. Repeats count.
    """
    digest = F.sha2(F.col(hash_col) if isinstance(hash_col, str) else hash_col, 256)
    # Decimal sums have room for 10^18 members.
    words = [F.conv(F.substring("_digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    totals = [F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    text = F.concat_ws(":", F.col("row_count").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return (
        df.select(*group, digest.alias("_digest"))
        .groupBy(*group)
        .agg(F.count("*").alias("row_count"), *totals)
        .select(*group, "row_count", F.sha2(text, 256).alias("fingerprint"))
    )


def canonical_row_key(rec: Column) -> Column:
    """Comparable text of a canonical record: supplier-local fields dropped, lists as sets."""
    kept = [
        "company", "title", "cities", "graduation_years", "education", "recruitment_type",
        "written_test", "deadline", "announcement_url", "apply_url", "official_job_id", "notes",
    ]

    def value(name: str) -> Column:
        if name in LIST_FIELDS:
            return clean_set(rec[name])
        if name == "official_job_id":
            return F.lower(strip_text(rec[name]))
        return rec[name]

    return F.to_json(F.struct(*[value(n).alias(n) for n in kept]))


def canonical_fingerprint(rows: DataFrame, group: Sequence[str] = ("batch_id",)) -> DataFrame:
    return multiset_fingerprint(
        rows.select(*group, canonical_row_key(F.col("rec")).alias("_key")), group, "_key"
    )


def independence_conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """Batches whose content is already registered under another independence group.

    Both inputs: batch_id, source_id, independence_group, file_hash, row_count, row_fingerprint,
    record_fingerprint. Each check is an equi-join against one line per content and group, so
    many copies of one batch do not multiply.
    """
    mine = new.select(
        "batch_id", "source_id", "independence_group", "file_hash", "row_count",
        "row_fingerprint", "record_fingerprint",
    )
    checks = []
    for rank, (code, keys) in enumerate(
        [
            ("same_file", ["file_hash"]),
            ("same_rows", ["row_count", "row_fingerprint"]),
            ("same_records", ["row_count", "record_fingerprint"]),
        ]
    ):
        # Two group names are enough to know whether another group holds the same content.
        seen = known.groupBy(*keys).agg(
            F.min("independence_group").alias("_lo"), F.max("independence_group").alias("_hi")
        )
        other = F.when(F.col("_lo") != F.col("independence_group"), F.col("_lo")).when(
            F.col("_hi") != F.col("independence_group"), F.col("_hi")
        )
        checks.append(
            mine.join(seen, keys)
            .select("batch_id", F.lit(rank).alias("rank"), F.lit(code).alias("code"), other.alias("other_group"))
            .filter(F.col("other_group").isNotNull())
        )
    found = reduce(DataFrame.unionByName, checks)
    return (
        found.groupBy("batch_id")
        .agg(F.min(F.struct("rank", "code", "other_group")).alias("v"))
        .select("batch_id", F.col("v.code").alias("code"), F.col("v.other_group").alias("other_group"))
    )


def _label(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def source_conflicts(new: DataFrame, registered: DataFrame) -> DataFrame:
    """Known source ids presented under another name, kind or group."""
    old = registered.select(
        "source_id", *[F.col(c).alias(f"_{c}") for c in ("name", "kind", "independence_group")]
    )
    fields = F.array_compact(
        F.array(
            F.when(_label(F.col("name")) != _label(F.col("_name")), F.lit("name")),
            F.when(F.col("kind") != F.col("_kind"), F.lit("kind")),
            F.when(
                F.trim("independence_group") != F.trim("_independence_group"), F.lit("independence_group")
            ),
        )
    )
    return (
        new.join(old, "source_id")
        .withColumn("fields", fields)
        .filter(F.size("fields") > 0)
        .select("source_id", "fields")
    )


def import_violations(batches: DataFrame, as_of: str) -> DataFrame:
    """Batches dated in the future or re-imported with another mapping."""
    limit = moment(as_of) + F.make_dt_interval(mins=F.lit(CLOCK_TOLERANCE_MINUTES))
    status = F.col("status") if "status" in batches.columns else F.lit("imported")
    code = F.when(F.col("snapshot_at") > limit, "snapshot_in_future").when(
        status == "mapping_changed", "mapping_changed"
    )
    return batches.withColumn("code", code).filter(F.col("code").isNotNull()).select("batch_id", "code")


def sync_summary(diff: DataFrame, meta: DataFrame, by: str = "source_id") -> DataFrame:
    """One run line per source: counts of the diff and the outcome.

    `meta` has source_id, row_count, field_count, import_status and error. A failed run carries
    its error and no counts; it replaces nothing.
    """
    counts = diff_counts(diff, [by])
    failed = F.col("error").isNotNull()
    status = (
        F.when(failed, "FAILED").when(F.col("import_status") == "already_imported", "NO_CHANGE").otherwise("SUCCESS")
    )
    numbers = [f"{c.lower()}_count" for c in CHANGES]
    return meta.join(counts, by, "left").select(
        by,
        status.alias("status"),
        *[
            F.when(failed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
            for c in ["row_count", "field_count", *numbers]
        ],
        F.coalesce("error", F.lit("")).alias("error"),
    )
