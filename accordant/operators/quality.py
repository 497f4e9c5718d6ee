"""Data-quality reports, seals and label comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.text import any_of, has_any
from accordant.operators.ingest import is_non_job_row
from accordant.operators.serving import side_by_side
from accordant.operators.snapshots import multiset_fingerprint
from accordant.session import fact_join, stored


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def distribution(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    kept = df.filter(where) if where else df
    return kept.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def distributions(specs: Sequence[tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """Several distributions under their names: (name, table, column, filter)."""
    return reduce(
        DataFrame.unionByName,
        [distribution(df, c, w).select(F.lit(name).alias("name"), "value", "rows") for name, df, c, w in specs],
    )


def lineage_coverage(raw: DataFrame, entities: DataFrame, origins: DataFrame) -> DataFrame:
    """Raw rows and entities with and without origin, with ratios."""

    def seen(df: DataFrame, key: str, name: str) -> DataFrame:
        held = origins.select(key).distinct().withColumn("_linked", F.lit(True))
        return df.select(key).join(held, key, "left").agg(
            F.count("*").alias("total"), F.count("_linked").alias("linked")
        ).select(
            F.lit(name).alias("scope"), "total", "linked",
            (F.col("total") - F.col("linked")).alias("unlinked"),
            ratio(F.col("linked"), F.col("total")).alias("coverage"),
        )

    return seen(raw, "raw_id", "raw").unionByName(seen(entities, "entity_id", "entity"))


def uniqueness_violations(df: DataFrame, keys: Sequence[str], where: str) -> DataFrame:
    """How many keys have more than one line."""
    return df.filter(where).groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("violations")
    )


def verification_counts(scoped: DataFrame, orgs: DataFrame) -> DataFrame:
    """Verified domains and attempts still in scope (see in_scope_attempts)."""
    domains = orgs.agg(F.count_if("domain_verified").alias("verified_domains"))
    return side_by_side(domains, scoped.agg(F.count("*").alias("in_scope_attempts")))


def supplier_audit(rows: DataFrame, rules: R.AuditRules = R.AuditRules()) -> DataFrame:
    """One line of heuristic shares. rows: company, title, cities_text, years_text, deadline, link_text."""
    jobs = rows.filter(~is_non_job_row(F.coalesce(F.nullif("company", F.lit("")), F.lit(" "))))

    def parts(c: str) -> Column:
        return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), rules.separators), lambda x: F.trim(x) != ""))

    title = F.coalesce("title", F.lit(""))
    multi_role = title.rlike(any_of(rules.generic_markers)) | (parts("title") >= 3)
    wanted = has_any(F.lower(title), [k.lower() for k in rules.target_keywords])
    target = (
        F.coalesce("years_text", F.lit("")).contains(rules.target_year)
        & F.coalesce("cities_text", F.lit("")).contains(rules.target_city)
        & wanted
    )
    checks = {
        "multi_role": multi_role,
        "multi_city": parts("cities_text") >= 2,
        "unclear_deadline": ~F.coalesce("deadline", F.lit("")).rlike(rules.date_pattern),
        "with_url": F.coalesce("link_text", F.lit("")).rlike(rules.url_pattern),
    }
    counts = jobs.agg(
        F.count("*").alias("job_rows"),
        *[F.count_if(test).alias(name) for name, test in checks.items()],
        F.count_if(target).alias("target_rows"),
    )
    return counts.select(
        "job_rows",
        *checks,
        *[ratio(F.col(n) * 100, F.col("job_rows"), 1).alias(f"{n}_percent") for n in checks],
        "target_rows",
    )


def top_values(rows: DataFrame, column: str, k: int = 8, empty: str = "空") -> DataFrame:
    """The k most frequent values; ties fall to the value."""
    return (
        rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)).alias("value"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.col("rows").desc(), F.col("value").asc())
        .limit(k)
    )


def table_seals(tables: Mapping[str, DataFrame], keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Content fingerprint per table, whatever the row order."""
    seals = []
    for name, df in sorted(tables.items()):
        text = (keys or {}).get(name)
        if text is None:
            text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        named = df.select(F.lit(name).alias("table_name"), text.alias("_row"))
        seals.append(multiset_fingerprint(named, ["table_name"], "_row"))
    return reduce(DataFrame.unionByName, seals)


def content_seal(seals: DataFrame) -> DataFrame:
    """One seal over all tables; there is one line per table to combine."""
    pairs = F.array_sort(F.collect_list(F.struct("table_name", "row_count", "fingerprint")))
    text = F.concat_ws(
        "\n",
        F.transform(pairs, lambda p: F.concat_ws("=", p["table_name"], p["row_count"].cast("string"), p["fingerprint"])),
    )
    return seals.agg(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("seal"))


def disallowed_sources(sources: DataFrame, allowed: Sequence[str], k: int = 3) -> DataFrame:
    """Up to k names of sources that may not be published."""
    return sources.filter(~F.col("kind").isin(*allowed)).orderBy("name", "source_id").limit(k).select("source_id", "name", "kind")


def require_allowed(sources: DataFrame, allowed: Sequence[str]) -> None:
    bad = [row["name"] for row in disallowed_sources(sources, allowed).collect()]
    if bad:
        raise ValueError("sources not allowed: " + ", ".join(bad))


def compare_labels(expected: DataFrame, actual: DataFrame, key: str, suite: str | None = None) -> DataFrame:
    """Cases, passes and pass rate per suite. expected/actual: key, label; expected may carry the suite."""
    group = [suite] if suite else []
    joined = expected.join(actual.withColumnRenamed("label", "_actual"), key, "left")
    passed = F.col("label").eqNullSafe(F.col("_actual"))
    return joined.groupBy(*group).agg(
        F.count("*").alias("cases"),
        F.count_if(passed).alias("passed"),
        F.round(F.avg(passed.cast("int")), 6).alias("pass_rate"),
    )


BUCKET = 100_000  # values that one task sorts for one rank
BINS = 1024


def finite(v: Column) -> Column:
    return ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))


def extent() -> list[Column]:
    """Aggregates over `v`: how many values, their ends, and the ends of the finite ones."""
    v = F.col("v")
    return [
        F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"),
        F.min(F.when(finite(v), v)).alias("low"), F.max(F.when(finite(v), v)).alias("high"),
    ]


def rank_values(values: DataFrame, ranks: DataFrame, group: str, bucket: int = BUCKET, bins: int = BINS) -> DataFrame:
    """(group, rank, value): the values at the wanted ranks, from 0, in each group's ascending order.

    values: group, v, no nulls. ranks: group, rank and the group's extent. Nothing is sorted as a whole: histograms narrow the range that
    holds a rank, each pass over the values that are left in it, until it holds one value only or at most
    `bucket` of them, which are sorted. A pass sends `bins` counts a rank and task. Infinite values and
    NaN, which sorts last, have bins of their own.
    """
    v = F.col("v")
    targets = ranks.withColumn("before", F.lit(0).cast("long"))
    while targets.filter(_open_range(bucket)).take(1):
        width = F.col("high") / 2 - F.col("low") / 2
        place = F.floor((v / 2 - F.col("low") / 2) / width * bins)
        spread = F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.when(v == F.col("low"), 0).otherwise(1))
        inner = F.when(finite(v), spread).when(F.isnan(v), bins + 1).otherwise(F.when(v > 0, bins).otherwise(-1))
        wide = targets.filter(_open_range(bucket))
        counted = within_ranges(values, wide, group).groupBy(group, "rank", inner.alias("bin")).agg(
            *extent(), F.max("before").alias("start"),
        )
        # At most a line for each bin of a rank.
        earlier = Window.partitionBy(group, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        held = placed.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        targets = stored(targets.filter(~_open_range(bucket)).unionByName(held.select(*targets.columns)), "ranks")
    alone = targets.filter("first = last").select(group, "rank", F.col("first").alias("value"))
    few = within_ranges(values, targets.filter("first <> last"), group).groupBy(group, "rank", "before").agg(
        F.array_sort(F.collect_list("v")).alias("all")
    )
    return alone.unionByName(few.select(group, "rank", F.element_at("all", (F.col("rank") - F.col("before") + 1).cast("int")).alias("value")))


def _open_range(bucket: int) -> Column:
    return (F.col("n") > bucket) & (F.col("first") != F.col("last"))


def within_ranges(values: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """The values in the range of each target of their group. A group has as many targets as wanted ranks."""
    columns = ("rank", "before", "first", "last", "low", "high")
    listed = targets.groupBy(group).agg(F.collect_list(F.struct(*columns)).alias("t"))
    met = F.filter("t", lambda t: (F.col("v") >= t["first"]) & (F.col("v") <= t["last"]))
    joined = fact_join(values, listed, [group], "inner").select(group, "v", F.explode(met).alias("t"))
    return joined.select(group, "v", *[F.col(f"t.{c}").alias(c) for c in columns])


def latency_stats(
    df: DataFrame, column: str, group: str, points: Sequence[tuple[str, float]] = (("median", 0.5), ("p95", 0.95)),
    digits: int = 4, bucket: int = BUCKET,
) -> DataFrame:
    """Min, max and exact interpolated percentiles per group, without sorting the values."""
    key = F.col(group)
    values = df.select(key, F.col(column).cast("double").alias("v")).filter("v is not null and " + f"`{group}` is not null")
    sizes = stored(values.groupBy(group).agg(*extent()), "extents")
    spots = {name: F.lit(p) * (F.col("n") - 1) for name, p in points}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(s), F.ceil(s)) for s in spots.values()])))
    found = rank_values(values, sizes.select("*", F.explode(wanted).alias("rank")), group, bucket)
    joined = fact_join(found, sizes.select(group, "n", F.col("first").alias("lo"), F.col("last").alias("hi")), [group], "inner")
    stats = []
    for name, spot in spots.items():
        lower = F.max(F.when(F.col("rank") == F.floor(spot), F.col("value")))
        upper = F.max(F.when(F.col("rank") == F.ceil(spot), F.col("value")))
        stats.append(F.round(lower + (upper - lower) * F.max(spot - F.floor(spot)), digits).alias(name))
    return joined.groupBy(group).agg(
        F.max("n").alias("samples"), F.round(F.max("lo"), digits).alias("min"), *stats, F.round(F.max("hi"), digits).alias("max")
    )


def append_events(events: DataFrame, new: DataFrame, actor: str = "system") -> DataFrame:
    """Audit log with the new events. new: entity_type, entity_id, event_type, created_at, payload (struct or map)."""
    lines = new.select(
        "entity_type",
        F.col("entity_id").cast("string").alias("entity_id"),
        "event_type",
        F.lit(actor).alias("actor"),
        F.to_json("payload").alias("payload"),
        "created_at",
    )
    return events.unionByName(lines.select(*events.columns))
