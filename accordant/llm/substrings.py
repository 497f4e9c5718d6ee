"""Substring dedup: words that stand in a run of `window` words which occurs elsewhere too.

The runs of `window` words are the edges of a De Bruijn graph over words. As in assemblers that
compact such graphs by minimizers, edges are never listed one by one where that can be avoided:

1. In each text, consecutive edges with the same minimizer (the smallest hash of `seed` words in
   the run) form a path. All occurrences of an edge have the same minimizer at the same place, so
   an edge can only repeat among paths with its minimizer. About one path stands for
   (window - seed + 2) / 2 edges.
2. Paths with equal words are counted by an aggregation. A minimizer with one kind of path is a
   nonbranching stretch: the path repeats as a whole or not at all.
3. At a branching minimizer (several kinds of paths) one occurrence of each kind is fetched by its
   source coordinates, taken apart into single edges, and the edges are counted with the weight
   of their path.
4. A join brings the repeated paths and edges back to their coordinates; overlapping ones compact
   into the spans that are removed.

Equality is that of a 64-bit hash of the words together with the 64-bit minimizer and the place of
the minimizer. A repeated passage is a few rows for each occurrence, never a pair of occurrences:
counts are pre-aggregated, and joins go to tables with one row for each key, so that Spark may
split a hot key.

Cases: null, empty and short texts have nothing to remove; repeated rows are occurrences of each
other; rows with a null id are treated like all others; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.words import Words, blocks, mix, small_batches, text_key
from accordant.session import fact_join, scratch_path

WINDOW = 35
SEED = 8
PATHS = "k1 long, k2 long, minimizer long, path long, place long"
EDGES = "minimizer long, shift int, edge long, n long, k1 long, k2 long, at int"


def smallest_seed(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the smallest, the first among equals."""
    # The low bits give way to the place: 24 of them, which is more than a block has words; only a
    # longer single text takes more.
    bits = np.uint64(max(24, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & low).astype(np.int64)


def paths_of(words: Words, window: int, seed: int):
    """Paths of edges with one minimizer: text, first word, edges, place of the minimizer, hashes."""
    at = words.windows(window)
    if not len(at):
        return None
    n = len(words.start)
    seeds = words.run_hashes(np.arange(n - seed + 1), seed)
    anchor = smallest_seed(seeds, window - seed + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    edges = np.diff(np.append(first, len(at)))
    start = at[first]
    shift = anchor[first] - start
    path = mix(words.run_hashes(start, edges + window - 1) + shift.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return words.text_of[start], start, edges, shift, seeds[anchor[first]], path


def find_paths(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs: k1, k2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                found = paths_of(words, window, seed)
                if found is None:
                    continue
                text, start, edges, shift, minimizer, path = found
                yield pa.RecordBatch.from_pydict(
                    {
                        "k1": batch.column(0)[rows.start : rows.stop].take(pa.array(text)),
                        "k2": batch.column(1)[rows.start : rows.stop].take(pa.array(text)),
                        "minimizer": pa.array(minimizer.view(np.int64)),
                        "path": pa.array(path.view(np.int64)),
                        "place": pa.array((start - words.first[text]) << 32 | shift << 16 | edges),
                    }
                )

    return docs.select("k1", "k2", "text").mapInArrow(run, PATHS)


def take_apart(kinds: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The single edges of one occurrence of each kind of path, read from the source texts.

    kinds: k1, k2, minimizer, n, place. A text's kinds are gathered beside it: no more than it has
    words.
    """
    wanted = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("minimizer", "n", "place")).alias("kinds"))
    texts = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                lists = batch.column(3)[rows.start : rows.stop]
                flat, text = lists.flatten(), lists_of(lists)
                place = flat.field("place").to_numpy()
                edges = place & 0xFFFF
                row = np.repeat(np.arange(len(edges)), edges)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(edges) - edges, edges)
                at = (place >> 32)[row] + nth
                hashes = words.run_hashes(words.first[text[row]] + at, window)
                key = pa.array(text[row])
                yield pa.RecordBatch.from_pydict(
                    {
                        "minimizer": flat.field("minimizer").take(pa.array(row)),
                        "shift": pa.array(((place >> 16 & 0xFFFF)[row] - nth).astype(np.int32)),
                        "edge": pa.array(hashes.view(np.int64)),
                        "n": flat.field("n").take(pa.array(row)),
                        "k1": batch.column(0)[rows.start : rows.stop].take(key),
                        "k2": batch.column(1)[rows.start : rows.stop].take(key),
                        "at": pa.array(at.astype(np.int32)),
                    }
                )

    return texts.select("k1", "k2", "text", "kinds").mapInArrow(run, EDGES)


def lists_of(lists: pa.Array) -> np.ndarray:
    """The row of each element of a list column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes)


def repeated_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(k1, k2, at, edges): runs of `edges` consecutive repeated edges, from word `at` of a text.

    docs: k1, k2, text, as text_key() makes them.
    """
    if not 1 <= seed <= window < 1 << 15:
        raise ValueError("a seed is at least one word and no longer than the window")
    spark = small_batches(docs.sparkSession)
    folder = scratch_path(spark, "paths")
    find_paths(docs, window, seed).write.option("compression", "zstd").parquet(folder)
    paths = spark.read.parquet(folder)

    keys = ["minimizer", "path"]
    kinds = paths.groupBy(*keys).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "place")))
    branches = kinds.groupBy("minimizer").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    useful = fact_join(kinds, branches, ["minimizer"]).filter("n > 1 OR kinds > 1")
    kinds_at = scratch_path(spark, "kinds")
    useful.write.option("compression", "zstd").parquet(kinds_at)
    useful = spark.read.parquet(kinds_at)
    repeated = fact_join(paths, useful.filter("n > 1").select(*keys), keys, "inner").select(
        "k1", "k2", F.expr("CAST(place >> 32 AS int)").alias("at"), F.expr("CAST(place & 65535 AS int)").alias("edges")
    )

    edges_at = scratch_path(spark, "edges")
    take_apart(useful.filter("kinds > 1"), docs, window).write.option("compression", "zstd").parquet(edges_at)
    edges = spark.read.parquet(edges_at)
    same = ["minimizer", "shift", "edge"]
    twice = edges.groupBy(*same).agg(F.sum("n").alias("total")).filter("total > 1").select(*same)
    single = fact_join(edges.filter("n = 1"), twice, same, "inner").select("k1", "k2", "at", F.lit(1).alias("edges"))
    return repeated.unionByName(single)


def gather_runs(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs with `runs`: the repeated runs of each text, no more than it has words."""
    runs = repeated_runs(docs, window, seed).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "edges")).alias("runs"))
    return docs.join(runs, ["k1", "k2"], "left")


def covered(words: Words, lists: pa.Array, window: int) -> np.ndarray:
    """Which words of a block stand in a repeated run."""
    flat, text = lists.flatten(), lists_of(lists)
    start = words.first[text] + flat.field("at").to_numpy()
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + flat.field("edges").to_numpy() + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def removal_report(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    return _kept(docs, window, seed, id_col, text_col, digest=True)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (first and last word, exclusive, of each removed span), text of the kept words."""
    return _kept(docs, window, seed, id_col, text_col, digest=False)


def _kept(docs: DataFrame, window: int, seed: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    keyed = text_key(docs, id_col, text_col)
    joined = gather_runs(keyed, window, seed).select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets)
                gone = covered(words, batch.column(2)[rows.start : rows.stop], window)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                raw, out, spans = data.tobytes(), [], []
                for d in range(len(offsets) - 1):
                    own = raw[offsets[d] : offsets[d + 1]].split()
                    if removed[d]:
                        mask = gone[words.first[d] : words.first[d + 1]]
                        own = [own[k] for k in np.flatnonzero(~mask)]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                    else:
                        spans.append([])
                    kept = b" ".join(own)
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                columns = {
                    "doc_id": batch.column(0)[rows.start : rows.stop],
                    "n_words": pa.array(words.count, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                }
                if digest:
                    columns["kept_sha256"] = pa.array(out, pa.string())
                else:
                    columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    columns["text"] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_words long, n_removed long, "
    return joined.mapInArrow(run, schema + ("kept_sha256 string" if digest else "spans array<struct<start: int, end: int>>, text string"))
