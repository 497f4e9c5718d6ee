"""SimHash near-duplicates: texts whose 64-bit fingerprints differ in at most two bits.

A fingerprint has a bit for every bit that is set in more than half of the hashes of a text's word
shingles. Linked fingerprints are found without comparing all pairs:

1. Equal fingerprints become one row with their smallest document, so copies cost nothing more.
2. Embedding: a fingerprint maps to the number of set bits in each of its 16 segments of four bits, a
   point of a grid. Two fingerprints that differ in d bits have points at a Manhattan distance of
   at most d. The range join: every occupied point goes to all grid cells within distance 1, and two
   points within distance 2 meet in some cell. Points that meet nobody drop out, the fingerprints of
   the others are the candidates of their cells.
3. Exact check: in a cell with up to DENSE fingerprints each pair is compared, and those that differ in
   at most two bits are links. Denser cells are split: their fingerprints go to themselves and to the 64
   values one bit away. Whoever meets there differs in at most two bits, and any two that differ in at
   most two bits meet. In each meeting place all are linked to the smallest, which gives as many links
   as visitors, not the square, and joins the same groups.
4. Groups are the connected components of these links.

No step lists the pairs of an unbounded group, and all counts and minima combine before they are shuffled.

Cases: a text without words has fingerprint zero and is linked like any other; one with fewer words
than a shingle is one shingle; null counts as empty; a very long text is a block of its own; repeated rows are copies; a group's id is
its smallest document id that is not null, null if there is none; an empty table gives no rows.
Other columns are not read by the report and pass unread through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.words import LOWER, Words, blocks, fresh, small_batches
from accordant.operators.graph import connect
from accordant.session import merge_join, scratch_path

SHINGLE = 3
SEED = 42
SEGMENTS = 16
DENSE = 32  # fingerprints of a grid cell whose pairs are compared one by one
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(raw: bytes, start: np.ndarray, end: np.ndarray, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words joined by a space; of all words if there are fewer."""
    import xxhash

    words = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
    width = min(width, len(words))
    line = b" ".join(words)
    stop = np.cumsum(end - start + 1) - 1
    first = stop - (end - start)
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(line[s:e], seed) for s, e in zip(first[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist())],
        np.uint64,
    )


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of a block of texts."""
    lower = LOWER[data]
    words, raw = Words(lower, offsets), lower.tobytes()
    hashes = [
        shingle_hashes(raw, words.start[a:b], words.end[a:b], width, seed) if b > a else np.zeros(0, np.uint64)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())
    ]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(n), np.uint64)
    for byte in range(8):
        value = (flat >> np.uint64(8 * byte)).astype(np.uint8)
        counts = np.bincount(text * 256 + value, minlength=256 * len(n)).reshape(len(n), 256) @ BITS_OF_BYTE
        for bit in range(8):
            out |= (2 * counts[:, bit] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """doc_id, k1, k2, fp, written once. k1 and k2 tell rows with another id or text apart."""
    small_batches(docs.sparkSession)
    doc, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(doc.cast("long"), F.xxhash64(doc, text), F.coalesce(doc.cast("long"), F.lit(-1)), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(data, offsets, width, seed) for _, data, offsets in blocks(batch.column(3))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    path = scratch_path(docs.sparkSession, "fingerprints")
    keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def segment_counts(fp: Column) -> Column:
    """The set bits of each four-bit segment, in the four bits of a long that the segment had."""
    ones = F.lit(0x1111111111111111)
    parts = [F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def cells_around(point: Column) -> Column:
    """The point and the grid cells at Manhattan distance 1, counts below zero left out."""
    near = [point]
    for k in range(SEGMENTS):
        one = F.lit(1 << 4 * k)
        near += [point + one, F.when(F.shiftrightunsigned(point, 4 * k).bitwiseAND(F.lit(15)) > 0, point - one)]
    return F.array_compact(F.array(*near))


def one_bit_around(fp: Column) -> Column:
    """The fingerprint and the 64 values that differ from it in one bit."""
    flips = [F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(f) for f in flips])


def grid_cells(fps: DataFrame) -> DataFrame:
    """(fp, cell, n): the cells around each fingerprint that another one visits too, with their numbers of visitors; written once."""
    pointed = fps.select("fp", segment_counts(F.col("fp")).alias("point"))
    cells = pointed.groupBy("point").agg(F.count("*").alias("n")).select("point", "n", F.explode(cells_around(F.col("point"))).alias("cell"))
    met = cells.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    near = merge_join(cells.select("point", "cell"), met, ["cell"], "inner")
    path = scratch_path(fps.sparkSession, "cells")
    merge_join(near, pointed, ["point"], "inner").select("fp", "cell", "n").write.parquet(path)
    return fps.sparkSession.read.parquet(path)


def pairs_in_cells(cells: DataFrame) -> DataFrame:
    """(fp, hub): the pairs of at most two bits in cells with up to DENSE visitors."""
    groups = cells.filter(F.col("n") <= DENSE).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    within = groups.select(F.explode("fps").alias("hub"), "fps")
    linked = F.filter("fps", lambda x: (x > F.col("hub")) & (F.bit_count(x.bitwiseXOR(F.col("hub"))) <= 2))
    return within.select(F.explode(linked).alias("fp"), "hub").distinct()


def stars_of_bits(fps: DataFrame) -> DataFrame:
    """(fp, hub): links that join fingerprints into the groups of all links of up to two bits."""
    path = scratch_path(fps.sparkSession, "places")
    fps.select("fp", F.explode(one_bit_around(F.col("fp"))).alias("place")).write.parquet(path)
    visits = fps.sparkSession.read.parquet(path)
    hubs = visits.groupBy("place").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("place", "hub")
    return merge_join(visits, hubs, ["place"], "inner").filter("fp <> hub").select("fp", "hub").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(fp, hub): links that join distinct fingerprints into the groups of all links of up to two bits."""
    cells = grid_cells(fps)
    dense = cells.filter(F.col("n") > DENSE).select("fp").distinct()
    return pairs_in_cells(cells).unionByName(stars_of_bits(dense)).distinct()


def group_roots(rows: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint that has a link."""
    found = links(rows.select("fp").distinct())
    members = found.select(F.col("fp").alias("node"), F.col("hub").alias("key"))
    hubs = found.select(F.col("hub").alias("node"), F.col("hub").alias("key"))
    return connect(members.unionByName(hubs)).select(F.col("node").alias("fp"), "root")


def rooted(rows: DataFrame) -> DataFrame:
    """rows with the root of their group."""
    roots = group_roots(rows).withColumnRenamed("root", "_root")
    return merge_join(rows, roots, ["fp"]).withColumn("root", F.coalesce("_root", "fp")).drop("_root")


def near_duplicate_report(docs: DataFrame, *, width: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the group)."""
    rows = rooted(fingerprint_rows(docs, id_col, text_col, width, seed)).select("doc_id", "fp", "root")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return merge_join(rows, least, ["root"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(docs: DataFrame, *, width: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each group: that with the smallest id (null last); one of equal rows."""
    rows = rooted(fingerprint_rows(docs, id_col, text_col, width, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first")
    a, b = fresh(docs, "k1", "k2")
    keep = rows.groupBy("root").agg(first).select(F.col("first.k1").alias(a), F.col("first.k2").alias(b))
    doc, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({a: F.xxhash64(doc, text), b: F.coalesce(doc.cast("long"), F.lit(-1))})
    return keyed.join(keep, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
