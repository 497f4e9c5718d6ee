"""Scheduled sync of landed snapshots: whatever arrived since the last run, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.operators.snapshots import multiset_fingerprint
from accordant.sources.store import write_batch


def describe_batches(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One line per landed batch; its content hash is the fingerprint of its row hashes."""
    prints = multiset_fingerprint(rows, ["batch_id", "source_id"], "row_hash")
    pairs = [x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))]
    times = rows.groupBy("batch_id").agg(F.max("landed_at").alias("imported_at"))
    return prints.withColumnRenamed("fingerprint", "file_hash").join(times, "batch_id").withColumn(
        "mapping", F.create_map(*pairs)
    )


def sync_landed(
    spark: SparkSession, folder: str, schema: str, root: str, progress: str, mapping: dict[str, str]
) -> None:
    """Append newly landed batches to the store under `root` and stop.

    Rows: batch_id, source_id, row_hash, landed_at and any others. A batch lands whole; a run takes
    all new files at once, and repeating one after a failure writes nothing twice.
    """

    def step(rows: DataFrame, _epoch: int) -> None:
        if rows.take(1):
            write_batch(rows, describe_batches(rows, mapping), root)

    query = (
        spark.readStream.schema(schema)
        .parquet(folder)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
