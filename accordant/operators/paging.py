"""Pages of a sorted table without sorting it for every page.

`after` seeks: the rows that follow the last one shown, in the order of the sort. `write_order` sorts once into ranges
and counts them, so that page k, wherever it is, reads only the ranges that hold its ranks.
Sort keys end in a unique column, or equal rows may change places between pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accordant.session import scratch_path


@dataclass(frozen=True)
class By:
    """One sort column. Nulls come last in either direction."""

    column: str
    descending: bool = False

    @property
    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.descending else F.col(self.column).asc_nulls_last()


def after(df: DataFrame, sort: Sequence[By], last: Sequence[object], size: int) -> DataFrame:
    """The next `size` rows behind a row with the sort values `last`."""
    follows, same = [], F.lit(True)
    for by, value in zip(sort, last, strict=True):
        column = F.col(by.column)
        if value is not None:
            beyond = column < F.lit(value) if by.descending else column > F.lit(value)
            follows.append(same & (beyond | column.isNull()))
        same = same & column.eqNullSafe(F.lit(value))
    behind = reduce(lambda a, b: a | b, follows, F.lit(False))
    return df.filter(behind).orderBy(*[by.order for by in sort]).limit(size)


@dataclass(frozen=True)
class StoredOrder:
    """A table in its order: one folder for each range, and how many rows come before it."""

    spark: SparkSession
    path: str
    schema: StructType
    before: dict[int, int]  # range -> rows in earlier ranges; as many entries as the table was dealt into
    total: int

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number`, from 1, with `rank` from 1 over the whole table; empty beyond the end."""
        if number < 1 or size < 1:
            raise ValueError("pages and their size begin at 1")
        first, end = (number - 1) * size, min(number * size, self.total)
        ranges = sorted(self.before)
        ends = dict(zip(ranges, [*[self.before[r] for r in ranges[1:]], self.total]))
        held = [r for r in ranges if self.before[r] < end and ends[r] > first]
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("_range").isin(held) if held else F.lit(False))
        offsets = F.create_map(*[F.lit(x) for r in held for x in (r, self.before[r])]) if held else None
        rank = (offsets[F.col("_range")] if held else F.lit(0)) + F.col("_place")
        ranked = rows.withColumn("rank", rank.cast("long")).filter((F.col("rank") >= first) & (F.col("rank") < end))
        return ranked.withColumn("rank", F.col("rank") + 1).drop("_range", "_place").orderBy("rank")


def write_order(df: DataFrame, sort: Sequence[By], ranges: int | None = None) -> StoredOrder:
    """Sort `df` once into ranges under the shared folder. Only one count for each range comes to the driver."""
    spark = df.sparkSession
    path = scratch_path(spark, "order")
    keys = [by.order for by in sort]
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    # The lower 33 bits of the id are the place of a row in its partition.
    placed = dealt.withColumns(
        {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed.write.partitionBy("_range").parquet(path)
    schema = placed.schema
    counted = spark.read.schema(schema).parquet(path).groupBy("_range").agg(F.count("*").alias("n"))
    sizes = {r["_range"]: r["n"] for r in counted.collect()}
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    return StoredOrder(spark, path, schema, before, total)
