"""Snapshots: diff, fingerprints, import guards, sync runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.operators import snapshots as S
from accordant.plans import workspace as W
from accordant.plans.registry import Tables, query, shared
from accordant.session import stored
from accordant.sources.store import admit_batches


def yearly_states(t: Tables) -> DataFrame:
    """A yearly snapshot of every customer: the statuses of the year's orders."""
    statuses = [F.max(F.when(F.col("o_orderstatus") == s, s)) for s in ("F", "O", "P")]
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.concat_ws(",", *statuses).alias("state")
    )


shared(
    "states",
    """SELECT o_custkey, year(o_orderdate) AS year, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS state
       FROM orders GROUP BY 1, 2""",
)
shared(
    "diff",
    """SELECT coalesce(c.o_custkey, p.o_custkey) AS custkey, coalesce(c.year, p.year + 1) AS year,
       CASE WHEN p.state IS NULL THEN 'ADDED' WHEN c.state IS NULL THEN 'MISSING' WHEN p.state = c.state THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change,
       coalesce(p.state, '') AS previous_state, coalesce(c.state, '') AS current_state
       FROM states c FULL OUTER JOIN states p ON p.o_custkey = c.o_custkey AND p.year + 1 = c.year""",
    "states",
)


def yearly_diff(t: Tables) -> DataFrame:
    states = yearly_states(t)

    def key(shift: int) -> Column:
        return F.concat_ws("-", F.col("o_custkey"), F.col("year") + shift)

    current = states.select(key(0).alias("record"), F.col("state"))
    previous = states.select(key(1).alias("record"), F.col("state"))
    diff = S.snapshot_diff(previous, current, "record", "state", checked=False)
    return diff.withColumn("year", F.substring_index("record", "-", -1).cast("int"))


@query(
    "d14_snapshot_diff",
    "SELECT custkey || '-' || year AS record, year, change, previous_state AS previous_hash, current_state AS current_hash FROM diff",
    ("diff",),
)
def d14(t: Tables) -> DataFrame:
    """Every year's snapshot of the customers against the year before."""
    return yearly_diff(t)


@query(
    "j13_sync_summary",
    """SELECT year, CASE WHEN count(*) FILTER (WHERE change <> 'MISSING') = 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE change IN ('MODIFIED', 'MISSING', 'UNCHANGED')) = 0 THEN 'NO_CHANGE' ELSE 'SUCCESS' END AS status,
       count(*) FILTER (WHERE change <> 'MISSING') AS row_count,
       CASE WHEN count(*) FILTER (WHERE change <> 'MISSING') = 0 THEN 0 ELSE 1 END AS field_count,
       count(*) FILTER (WHERE change = 'ADDED') AS added_count, count(*) FILTER (WHERE change = 'MODIFIED') AS modified_count,
       CASE WHEN count(*) FILTER (WHERE change <> 'MISSING') = 0 THEN 0 ELSE count(*) FILTER (WHERE change = 'MISSING') END AS missing_count,
       count(*) FILTER (WHERE change = 'UNCHANGED') AS unchanged_count,
       CASE WHEN count(*) FILTER (WHERE change <> 'MISSING') = 0 THEN 'empty_after_rows' ELSE '' END AS error
       FROM diff GROUP BY year""",
    ("diff",),
)
def j13(t: Tables) -> DataFrame:
    """One run line per year; a year without rows after one with rows is a failed load."""
    diff = yearly_diff(t)
    seen = diff.groupBy("year").agg(
        F.count_if(F.col("change") != "MISSING").alias("row_count"),
        F.count_if(F.col("change") != "ADDED").alias("earlier"),
    )
    meta = seen.select(
        "year",
        "row_count",
        F.lit(1).alias("field_count"),
        F.when(F.col("earlier") == 0, "already_imported").otherwise("imported").alias("import_status"),
        F.when(F.col("row_count") == 0, "empty_after_rows").alias("error"),
    )
    return S.sync_summary(diff, meta, "year")


def row_text(t: Tables) -> DataFrame:
    return t.lineitem.select(
        W.batch_id().alias("batch_id"),
        F.col("l_suppkey").alias("source_id"),
        F.year("l_shipdate").alias("year"),
        F.concat_ws("|", "l_partkey", "l_returnflag", "l_linestatus").alias("row_text"),
        "l_partkey", "l_returnflag", "l_linestatus",
    )


FINGERPRINT = (
    "sha256(count(*) || "
    + " || ".join(
        f"':' || sum(CAST(CAST('0x' || substr(sha256({{0}}), {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT))" for i in range(4)
    )
    + ")"
)
ROW_TEXT = "concat_ws('|', l_partkey, l_returnflag, l_linestatus)"


@query(
    "j7_multiset_fingerprint",
    f"""SELECT l_suppkey || '-' || year(l_shipdate) AS batch_id, count(*) AS row_count, {FINGERPRINT.format(ROW_TEXT)} AS fingerprint
        FROM lineitem GROUP BY 1""",
)
def j7(t: Tables) -> DataFrame:
    """Order-insensitive fingerprint of every supplier's yearly batch."""
    return S.multiset_fingerprint(row_text(t), ["batch_id"], "row_text")


def records(t: Tables, industry: str = "") -> DataFrame:
    """The order lines as canonical records."""
    rows = row_text(t)
    empty = F.lit("")
    values = {
        "company": F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
        "title": F.col("l_returnflag"),
        "cities": F.array(F.lit(" b"), F.col("l_linestatus"), F.lit("b ")),
        "industry": F.lit(industry),
        "source_record_id": F.lit(None).cast("string"),
        "official_job_id": F.concat(F.lit(" J"), F.col("l_partkey").cast("string")),
    }
    rec = F.struct(
        *[
            values.get(f, F.array().cast("array<string>") if f in R.LIST_FIELDS else empty).alias(f)
            for f in R.FIELD_ALIASES
        ]
    )
    return rows.withColumn("rec", rec)


CANONICAL_TEXT = (
    """'{"company":"part ' || l_partkey || '","title":"' || l_returnflag || '","cities":["' || l_linestatus || '","b"],"""
    """"graduation_years":[],"education":[],"recruitment_type":"","written_test":"","deadline":"","announcement_url":"","""
    """"apply_url":"","official_job_id":"j' || l_partkey || '","notes":""}'"""
)


@query(
    "d17_canonical_fingerprint",
    f"""SELECT l_suppkey || '-' || year(l_shipdate) AS batch_id, count(*) AS row_count, {FINGERPRINT.format(CANONICAL_TEXT)} AS fingerprint
        FROM lineitem GROUP BY 1""",
)
def d17(t: Tables) -> DataFrame:
    """Fingerprint of the normalised records of every batch."""
    return S.canonical_fingerprint(records(t))


def registered_batches(t: Tables) -> DataFrame:
    prints = S.multiset_fingerprint(row_text(t), ["batch_id"], "row_text").withColumnRenamed("fingerprint", "row_fingerprint")
    canon = S.canonical_fingerprint(records(t)).select("batch_id", F.col("fingerprint").alias("record_fingerprint"))
    return (
        prints.join(canon, "batch_id")
        .withColumn("source_id", F.substring_index("batch_id", "-", 1).cast("long"))
        .withColumn("year", F.substring_index("batch_id", "-", -1).cast("int"))
        .join(W.sources(t).select("source_id", "independence_group"), "source_id")
        .withColumn("file_hash", F.sha2(F.concat(F.lit("file:"), "batch_id"), 256))
    )


@query(
    "d16_independence_conflicts",
    """SELECT b.batch_id, CASE WHEN year(b.snapshot_at) < 1997 THEN 'same_file' WHEN year(b.snapshot_at) < 1999 THEN 'same_rows' ELSE 'same_records' END AS code,
       s.independence_group AS other_group
       FROM batches b JOIN sources s ON s.source_id = b.source_id WHERE s.independence_group < 'n2'""",
    ("batches", "sources"),
)
def d16(t: Tables) -> DataFrame:
    """All batches offered again by copies: verbatim, re-saved, and with other spacing.

    Copies of groups from n2 on keep the group and are allowed; the others claim a new one.
    """
    # Both sides and all three checks read the fingerprints, so they are worked out once.
    known = stored(registered_batches(t), "registered")
    offered = known.withColumns(
        {
            "independence_group": F.when(F.col("independence_group") < "n2", "claimed").otherwise(F.col("independence_group")),
            "file_hash": F.when(F.col("year") < 1997, F.col("file_hash")).otherwise(F.sha2(F.concat(F.lit("copy:"), "batch_id"), 256)),
            "row_fingerprint": F.when(F.col("year") < 1999, F.col("row_fingerprint")).otherwise(F.lit("other spacing")),
        }
    )
    return S.independence_conflicts(offered, known)


@query(
    "d18_source_conflicts",
    """SELECT source_id, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'name' END, CASE WHEN s_acctbal > 5000 THEN 'kind' END,
         CASE WHEN s_nationkey < 5 THEN 'independence_group' END) AS fields
       FROM sources JOIN supplier ON s_suppkey = source_id WHERE s_acctbal < 0 OR s_acctbal > 5000 OR s_nationkey < 5""",
    ("sources",),
)
def d18(t: Tables) -> DataFrame:
    """Suppliers presented again with wider spacing, and some with another name, kind or group."""
    known = W.sources(t)
    balance = t.supplier.select(F.col("s_suppkey").alias("source_id"), "s_acctbal", "s_nationkey")
    offered = known.join(balance, "source_id").select(
        "source_id",
        F.when(F.col("s_acctbal") < 0, F.concat("name", F.lit(" Ltd"))).otherwise(F.concat(F.lit("  "), "name", F.lit(" "))).alias("name"),
        F.lit("PAID_TABLE").alias("kind"),
        F.when(F.col("s_nationkey") < 5, "z").otherwise(F.concat("independence_group", F.lit(" "))).alias("independence_group"),
    )
    conflicts = S.source_conflicts(offered, known)
    return conflicts.select("source_id", F.concat_ws(",", "fields").alias("fields"))


@query(
    "d19_import_violations",
    """SELECT batch_id, CASE WHEN snapshot_at > TIMESTAMP '2001-03-01 00:05:00' THEN 'snapshot_in_future' ELSE 'mapping_changed' END AS code
       FROM batches WHERE snapshot_at > TIMESTAMP '2001-03-01 00:05:00' OR row_count > 100""",
    ("batches",),
)
def d19(t: Tables) -> DataFrame:
    """Batches from after the given day, and large ones as if imported with another mapping."""
    offered = W.batches(t).withColumn(
        "status", F.when(F.col("row_count") > 100, "mapping_changed").otherwise("imported")
    )
    return S.import_violations(offered, "2001-03-01 00:00:00")


@query(
    "a6_admit_batches",
    """SELECT batch_id, CASE WHEN year(snapshot_at) >= 2000 THEN 'imported' WHEN row_count > 100 THEN 'mapping_changed' ELSE 'already_imported' END AS status
       FROM batches""",
    ("batches",),
)
def a6(t: Tables) -> DataFrame:
    """Batches against those already stored: new, known, or known under another mapping."""
    offered = W.batches(t).select(
        "batch_id", "source_id", F.sha2("batch_id", 256).alias("file_hash"), "snapshot_at", "imported_at", "row_count",
        F.create_map(F.lit("title"), F.lit("l_returnflag")).alias("mapping"),
    )
    column = F.when(F.col("row_count") > 100, "l_linestatus").otherwise("l_returnflag")
    stored = offered.filter(F.year("snapshot_at") < 2000).withColumn("mapping", F.create_map(F.lit("title"), column))
    return admit_batches(offered, stored).select("batch_id", "status")
