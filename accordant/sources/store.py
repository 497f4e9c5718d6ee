"""Append-only batch store on a shared file system, committed in numbered generations.

A load writes its rows and batch lines into folders of its own and then creates the next manifest, which names them.
A manifest is created only if its number is free, so of two loads at once one finds out that it came second
and judges its files again beside what the first admitted. Readers follow the manifests and therefore see whole loads
only; folders that no manifest names are leftovers of a lost driver.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import checkpoint

MANIFESTS, RAW, BATCHES = "manifests", "raw", "batches"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def committed_loads(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed loads in order; one short file for each load is read."""
    files, folder = _folder(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    numbered = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().isdigit())
    jvm, loads = spark.sparkContext._jvm, []
    for name in numbered:
        stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            loads.append(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
        finally:
            stream.close()
    return loads


def commit_load(spark: SparkSession, root: str, number: int, load: str) -> bool:
    """Create manifest `number` for a load; False if that number is taken.

    The file is written aside and renamed without overwriting, which is one step on file systems with atomic renames.
    """
    jvm = spark.sparkContext._jvm
    files, folder = _folder(spark, f"{root}/{MANIFESTS}")
    files.mkdirs(folder)
    aside, name = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"_{load}", f"{number:010d}"))
    stream = files.create(aside, True)
    stream.write(load.encode())
    stream.close()
    never = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(files.makeQualified(aside), files.makeQualified(name), never)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        files.delete(aside, False)
        return False
    return True


def read_committed(spark: SparkSession, root: str, table: str, loads: list[str] | None = None) -> DataFrame | None:
    """A table of the store as the manifests have it, or None if nothing was committed."""
    loads = committed_loads(spark, root) if loads is None else loads
    if not loads:
        return None
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/load={load}" for load in loads])
    return rows.drop("load")


def admit_batches(batches: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Add `status`: imported, already_imported, or mapping_changed for a known file.

    A file may come twice in one load: its first batch (by import time and id) is imported, the
    others count as known.
    """

    def first(df: DataFrame, name: str) -> DataFrame:
        line = F.struct("imported_at", "batch_id", F.to_json("mapping").alias("mapping"))
        return df.groupBy("source_id", "file_hash").agg(F.min(line).alias(name))

    files = first(batches, "own")
    if existing is not None:
        files = files.join(first(existing, "old"), ["source_id", "file_hash"], "left")
    else:
        files = files.withColumn("old", F.lit(None).cast(files.schema["own"].dataType))
    return (
        batches.join(files.withColumn("k", F.coalesce("old", "own")), ["source_id", "file_hash"])
        .withColumn(
            "status",
            F.when(F.col("old").isNull() & (F.col("batch_id") == F.col("own.batch_id")), "imported")
            .when(F.to_json("mapping") == F.col("k.mapping"), "already_imported")
            .otherwise("mapping_changed"),
        )
        .withColumn("batch_id", F.col("k.batch_id"))
        .drop("k", "own", "old")
    )


def write_batch(rows: DataFrame, batches: DataFrame, root: str) -> DataFrame:
    """Append new batches and their rows; known files are left alone.

    What a lost driver leaves behind is named by no manifest, so a retry starts anew. A load that
    another one overtook judges its batches again.
    """
    spark = rows.sparkSession
    while True:
        loads = committed_loads(spark, root)
        verdict = checkpoint(admit_batches(batches, read_committed(spark, root, BATCHES, loads)))
        changed = verdict.filter("status = 'mapping_changed'").select("source_id", "file_hash").take(3)
        if changed:
            raise ValueError(f"mapping_changed: {changed}")
        shown = verdict.select("batch_id", "source_id", "file_hash", "status")
        fresh = verdict.filter("status = 'imported'").select("batch_id")
        if not fresh.take(1):
            return shown
        load = uuid.uuid4().hex
        kept = rows.join(fresh, "batch_id", "left_semi")
        kept.write.partitionBy("source_id", "batch_id").parquet(f"{root}/{RAW}/load={load}")
        batches.join(fresh, "batch_id", "left_semi").write.parquet(f"{root}/{BATCHES}/load={load}")
        if commit_load(spark, root, len(loads) + 1, load):
            return shown
        for table in (RAW, BATCHES):
            files, path = _folder(spark, f"{root}/{table}/load={load}")
            files.delete(path, True)


def sample_snapshot(rows: DataFrame, batches: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows of every batch, under a file hash that says so."""
    kept = rows.filter(F.col("row_number") <= n)
    marked = batches.withColumn("file_hash", F.concat("file_hash", F.lit(f":sample:{n}")))
    return kept, marked
