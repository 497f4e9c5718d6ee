"""A stored index of three-character pieces for substring search over short text columns.

A term's rarest pieces name the few rows that may hold it, and the texts themselves decide. Postings are
dealt out and sorted by piece (a frequent piece spans several files), so a search reads the ranges of its pieces.
Terms of one or two characters have no piece and are searched by a scan. Search is literal and ignores case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import scratch_path

PIECE = 3
USED = 3  # rarest pieces of a term that are intersected


def pieces(text: Column) -> Column:
    """The distinct pieces of a text."""
    starts = F.when(F.length(text) >= PIECE, F.sequence(F.lit(1), F.length(text) - (PIECE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, PIECE)))


@dataclass(frozen=True)
class SearchIndex:
    """Postings (piece, key), how often each piece occurs, and the searched texts, under one folder."""

    spark: SparkSession
    path: str
    key: str

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def candidates(self, term: str) -> DataFrame:
        """Keys of the rows that hold the term's rarest pieces; all keys for a term without pieces."""
        low = term.lower()
        wanted = sorted({low[k : k + PIECE] for k in range(len(low) - PIECE + 1)})
        if not wanted:
            return self._read("texts").select(self.key)
        # As many rows as the term has pieces.
        known = {r["piece"]: r["n"] for r in self._read("sizes").filter(F.col("piece").isin(wanted)).collect()}
        if len(known) < len(wanted):
            return self._read("texts").select(self.key).limit(0)
        rare = sorted(wanted, key=lambda p: (known[p], p))[:USED]
        postings = self._read("postings").filter(F.col("piece").isin(rare))
        return postings.groupBy(self.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select(self.key)

    def search(self, term: str) -> DataFrame:
        """Keys of all rows with the term in one of the indexed columns."""
        low = term.lower()
        texts = self._read("texts")
        met = texts if len(low) < PIECE else texts.join(self.candidates(term), self.key, "left_semi")
        return met.filter(F.exists("texts", lambda x: x.contains(low))).select(self.key)


def build_index(rows: DataFrame, key: str, columns: Sequence[str]) -> SearchIndex:
    """Index the columns of `rows`; null texts hold nothing. `key` names a row and is not null."""
    spark = rows.sparkSession
    path = scratch_path(spark, "search-index")
    found = F.array_compact(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]))
    rows.select(key, found.alias("texts")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    listed = texts.select(key, F.explode(F.array_distinct(F.flatten(F.transform("texts", pieces)))).alias("piece"))
    order = [F.col("piece"), F.col(key)]
    listed.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").groupBy("piece").agg(F.count("*").alias("n"))
    sizes.repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{path}/sizes")
    return SearchIndex(spark, path, key)
