"""Session settings and the few physical-plan helpers every operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # profile texts may be in GB18030
    # A skewed join is split even when a later step would have liked its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled rows of few values compress far below a tenth, so a task that reads 64 MB of them needs gigabytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

HOT_BINS = 4096


# Checkpoints nobody refers to any more are removed.
STATIC_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "accordant", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    A folder of our own is used only where none is set and driver and executors are one process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="accordant-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/accordant-scratch/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written under the shared folder and read back: lineage is cut, and its size is known to later joins."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of ours once what was made of it is written."""
    if "/accordant-scratch/" not in path:
        raise ValueError(f"not a scratch path: {path}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def fact_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join rows to a table holding at most one line per key, safe for hot keys.

    The extra key makes Spark exchange both inputs for this join alone, so adaptive
    execution may split a hot partition of `rows`; an aggregate feeding the join directly
    would pin the partitioning and leave the hot key to one task. It is 0 on every line, which
    costs next to nothing in a shuffle, but only known row by row, so no rule takes it out.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1))
    return (
        rows.withColumn("_hk", hashed)
        .join(facts.withColumn("_hk", hashed), [*keys, "_hk"], how)
        .drop("_hk")
    )


def merge_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """fact_join that never broadcasts, for narrow tables: a broadcast passes through the driver, and Spark sizes
    a table behind an explode as if it had one row for each of before, so it would broadcast far more than its limit.
    """
    return fact_join(rows, facts.hint("merge"), keys, how)


def split_hot(
    rows: DataFrame, key: str, counted: DataFrame | None = None, floor: int = 100_000, parts: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows dealt out by `key`, rows of hot keys or None): what groups by `key` needs no further exchange for the first.

    Rows are counted by a hash of the key in HOT_BINS bins; a bin with more than `floor` rows and 8 times its share is hot.
    `counted` may hold the same rows, or more, at less cost. `parts`: number of partitions of the first.
    """
    bin_ = F.pmod(F.xxhash64(key), F.lit(HOT_BINS))
    sizes = (rows if counted is None else counted).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect()
    limit = max(floor, 8 * sum(r["n"] for r in sizes) / HOT_BINS)
    hot = [r["bin"] for r in sizes if r["n"] > limit]

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(key) if parts is None else df.repartition(parts, key)

    if not hot:
        return deal(rows), None
    return deal(rows.filter(~bin_.isin(hot))), rows.filter(bin_.isin(hot))


def first_per_group(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """Keep the first n rows per key.

    Spark trims every map-side group to n rows before the shuffle, so a hot key costs n rows
    per task.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str = "row_number", group: str | None = None
) -> DataFrame:
    """Dense 1-based numbering in a total order, without one task seeing every row.

    Rows are range-partitioned and checkpointed once; only per-partition counts are combined
    afterwards, and there are as many of those as partitions (times groups, if given).
    """
    keys = [F.col(group).asc(), *order] if group else list(order)
    ordered = checkpoint(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    scope = ["_part", group] if group else ["_part"]
    sizes = ordered.groupBy(*scope).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*([group] if group else [])).orderBy("_part")
    offsets = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    return (
        ordered.join(offsets, scope)
        .withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        .drop("_part", "_seq", "_first", "_before")
    )
