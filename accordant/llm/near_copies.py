"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

All pairs at that similarity are found, and no other is linked:

1. A shingle set becomes a 64-bit key, and texts of one key one node, so copies cost nothing more.
2. Prefixes: of two sets at 4/5 the smaller one has one of its n - ceil(8n/9) + 1 first shingles among the
   n - ceil(4n/5) + 1 first of the larger one, whatever the order of shingles, if it is the same for all. Here
   shingles that are frequent in a sample of texts come last, the others by their hashes. The sample, like
   the bound on the list of frequent shingles, only decides how many candidates there are. Shingles that
   only one node has leave first.
3. Sketches: a set's parities of hash bits, about a bit for each shingle. Two sketches differ in no more bits
   than the sets in shingles, and sets at 4/5 differ in at most a ninth of the sum of their sizes. So a
   candidate whose sketches differ in more is none; full sets are fetched for the others only.
4. Stars: each node is compared with the smallest node of each of its prefix shingles, and with the
   hubs of the SimHash links; the smallest whose sketch is close is verified. Groups of near copies are mostly
   joined by these few comparisons.
5. Rounds: under shingles where over DENSE nodes of several groups meet, each node is compared with a hub of another
   group, at first that with the fewest rarer shingles, then any; so a large group of near copies comes together
   by as many comparisons as places, not by its pairs. Rounds end when one finds no link, or after ROUNDS.
6. The rest: nodes that meet under a prefix shingle and are not in one group yet are compared, all of them.
   Shingle and size (in steps of 5/4) are the key, so that frequent shingles split. Sketches folded to FOLDED words
   go along, and the join itself leaves out what they tell apart.
7. A candidate becomes a link if the full sets are at 4/5, counted in whole numbers. Groups are the
   connected components of the links.

Every table that a step writes is deleted when the next one's result is written.

Shingles are compared by 64-bit hashes. Cases: a text with fewer words than a shingle is one shingle;
null counts as empty, and texts without words are copies; a very long text is worked on as a block of
its own; ids are treated as in simhash; repeated rows are copies, and one of them stays; of copies and
groups the smallest id stays; an empty table stays empty; further columns pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm import simhash
from accordant.llm.words import LOWER, Words, blocks, fresh, mix, small_batches
from accordant.operators.graph import contract
from accordant.session import delete_path, fact_join, merge_join, scratch_path

SHINGLE = 5
SAMPLE = 16  # frequent shingles are looked for in one of so many texts
FREQUENT = 3
LISTED = 1 << 18
DENSE = 32  # places of a prefix shingle from which on hubs are tried before all pairs
ROUNDS = 3
FOLDED = 4  # words of a folded sketch; sets of more than FULL shingles have as many at least
FULL = 128


class Scratch:
    """Tables under the shared folder, by name, until nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_path(df.sparkSession, name)
        df.write.parquet(self.paths[name])
        return df.sparkSession.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, df: DataFrame, *names: str) -> None:
        """Delete tables that all further steps can do without; the collection lets Spark remove shuffles that no plan refers to."""
        spark = df.sparkSession
        for name in names:
            delete_path(spark, self.paths.pop(name))
        spark.sparkContext._jvm.System.gc()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the different shingles of each text of a block, sorted, and where each text's begin."""
    words = Words(LOWER[data], offsets)
    n = np.where(words.count > 0, np.maximum(1, words.count - width + 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - (np.cumsum(n) - n)[text] + words.first[:-1][text]
    hashes = words.run_hashes(at, np.minimum(words.count, width)[text]) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def prefixes(hashes: np.ndarray, first: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set that a set at 4/5 can't miss all of. listed: frequent shingles, the rarest first."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(hashes), np.int64)
    if len(listed):
        by_hash = np.argsort(listed)
        at = np.minimum(np.searchsorted(listed, hashes, sorter=by_hash), len(listed) - 1)
        rank = np.where(listed[by_hash[at]] == hashes, by_hash[at] + 1, 0)
    order = np.lexsort((hashes, rank, text))
    size = np.where(n > 0, n + (-4 * n // 5) + 1, 0)
    taken = np.arange(len(hashes)) - first[:-1][text] < size[text]
    return hashes[order][taken], np.concatenate([[0], np.cumsum(size)])


def sketches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set the parities of its hashes per bit, in a power of two of 64-bit words with a bit for each hash at least."""
    n = np.diff(first)
    words = 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    text = np.repeat(np.arange(len(n)), n)
    place = (mix(hashes) & (64 * words - 1).astype(np.uint64)[text]).astype(np.int64) + 64 * begin[:-1][text]
    odd = (np.bincount(place, minlength=64 * int(begin[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), begin


def list_of(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def frequent(texts: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """At most LISTED shingles that are frequent in a sample of the texts, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                found, n = np.unique(shingle_sets(data, offsets, width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

    sample = texts.filter(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = scratch.write(found.filter(F.col("n") >= FREQUENT), "frequent")
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = LISTED, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    top = counts.filter(step >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "hash"])
    scratch.drop(texts, "frequent")
    return top["hash"].to_numpy(np.int64).view(np.uint64)


def set_rows(keyed: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """doc_id, k1, k2, fp, node, size, prefix, sketch of each row of (doc_id, k1, k2, text), written once."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(frequent(keyed, width, scratch))
    names = ["doc_id", "k1", "k2", "fp", "node", "size", "prefix", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(3)):
                hashes, first = shingle_sets(data, offsets, width)
                part = batch.slice(rows.start, rows.stop - rows.start)
                fp, node = simhash.fingerprints(data, offsets, width), set_keys(hashes, first)
                columns = [pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), pa.array(np.diff(first))]
                columns += [list_of(*prefixes(hashes, first, shared.value)), list_of(*sketches(hashes, first))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=names)

    schema = "doc_id long, k1 long, k2 long, fp long, node long, size long, prefix array<long>, sketch array<long>"
    return scratch.write(keyed.mapInArrow(run, schema), "shingle-sets")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and values, its shingles, of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), list_of(*shingle_sets(data, offsets, width))], names=["node", "values"])

    return texts.mapInArrow(run, "node long, values array<long>")


def close_sizes(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be at 4/5."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def close_sketches(a: Column, b: Column, sizes: Column) -> Column:
    """Whether sets with these sketches can be at 4/5. Halves of the longer sketch, one on the other, are the shorter one's bits."""

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    left = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a)
    right = F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(left, right, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, x: n + x)
    return 9 * apart <= sizes


def folded(sketch: Column) -> Column:
    """A sketch of FOLDED words of its bits; sketches of fewer words come with zeros, and only `folds_close` may read them."""

    def word(k: int) -> Column:
        return F.aggregate(F.filter(sketch, lambda _, i: i % FOLDED == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    return F.named_struct(*(x for k in range(FOLDED) for x in (F.lit(f"w{k}"), word(k))))


def folds_close(a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """Whether sets with these folded sketches can be at 4/5. If one has fewer words, both are folded to a single word."""
    words = [a[f"w{k}"].bitwiseXOR(b[f"w{k}"]) for k in range(FOLDED)]
    one, apart = words[0], F.bit_count(words[0])
    for w in words[1:]:
        one, apart = one.bitwiseXOR(w), apart + F.bit_count(w)
    return 9 * F.when(F.least(a_size, b_size) > FULL, apart).otherwise(F.bit_count(one)) <= a_size + b_size


def close_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave."""
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("sketch").alias("left"))
    other = nodes.select(F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("sketch").alias("right"))
    both = merge_join(merge_join(pairs, one, ["a"], "inner"), other, ["b"], "inner").filter(close_sizes(F.col("a_size"), F.col("b_size")))
    return both.filter(close_sketches(F.col("left"), F.col("right"), F.col("a_size") + F.col("b_size"))).select("a", "b")


def verified(close: DataFrame, nodes: DataFrame, keyed: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are at 4/5, that is, share at least 4/9 of the sum of their sizes."""
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    ends = merge_join(nodes.select("node", "row.k1", "row.k2"), ends, ["node"], "inner")
    texts = fact_join(keyed.select("k1", "k2", "text"), ends, ["k1", "k2"], "inner").select("node", "text").dropDuplicates(["node"])
    sets = scratch.write(full_sets(texts, width), "full-sets")
    one = sets.select(F.col("node").alias("a"), F.col("values").alias("left"))
    other = sets.select(F.col("node").alias("b"), F.col("values").alias("right"))
    both = merge_join(merge_join(close, one, ["a"], "inner"), other, ["b"], "inner")
    return both.filter(9 * F.size(F.array_intersect("left", "right")) >= 4 * (F.size("left") + F.size("right"))).select("a", "b")


def simhash_stars(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of one fingerprint or of linked ones, each with the smallest of the other's."""
    hubs = nodes.groupBy("fp").agg(F.min("node").alias("b"))
    equal = merge_join(nodes.select("node", "fp"), hubs, ["fp"], "inner").select(F.col("node").alias("a"), "b")
    linked = merge_join(simhash.links(nodes.select("fp").distinct()), hubs.withColumnRenamed("b", "a"), ["fp"], "inner").select("a", F.col("hub").alias("fp"))
    return equal.unionByName(merge_join(linked, hubs, ["fp"], "inner").select("a", "b")).filter("a <> b")


def size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.25))).cast("int")


def several_groups(met: DataFrame, groups: DataFrame, floor: int = 1) -> DataFrame:
    """The rows of `met` with their group as `root`, for shingles of several groups and more than `floor` rows."""
    parted = merge_join(met.drop("hub"), groups, ["node"]).withColumn("root", F.coalesce("root", "node"))
    ends = parted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return merge_join(parted, ends.filter((F.col("low") != F.col("high")) & (F.col("n") > floor)).select("token"), ["token"], "inner")


def hub_pairs(met: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes under dense shingles with the shingle's hub of this turn, of another group, that can be at 4/5."""
    dense = several_groups(met, groups, DENSE)
    first = F.struct(F.col("pos") if turn == 0 else F.xxhash64("token", "node", F.lit(turn)), F.col("node"))
    hubs = dense.groupBy("token").agg(F.min_by(F.struct("node", "size", "root", "fold"), first).alias("hub"))
    both = merge_join(dense, hubs, ["token"], "inner").filter(F.col("root") != F.col("hub.root"))
    sizes = F.col("size"), F.col("hub.size")
    possible = close_sizes(*sizes) & folds_close(F.col("fold"), F.col("hub.fold"), *sizes)
    return both.filter(possible).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def other_pairs(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): nodes of different groups that can be at 4/5 by folded sketches and their places under a shingle of both prefixes."""
    left = several_groups(met, groups)
    size, pos = F.col("size"), F.col("pos")
    indexed = left.filter(pos <= size - F.ceil(8 * size / 9)).withColumn("step", F.explode(F.sequence(size_class(size), size_class(F.floor(5 * size / 4)))))
    probes = left.withColumn("step", size_class(size)).select("token", "step", *(F.col(c).alias(f"b_{c}") for c in ("node", "size", "pos", "root", "fold")))
    both = indexed.join(probes.hint("merge"), ["token", "step"]).filter(F.struct("size", "node") < F.struct("b_size", "b_node")).filter("root <> b_root")
    most = F.least("pos", "b_pos") + 1 + F.least(F.col("size") - F.col("pos"), F.col("b_size") - F.col("b_pos")) - 1
    possible = close_sizes(F.col("size"), F.col("b_size")) & (9 * most >= 4 * (F.col("size") + F.col("b_size")))
    close = folds_close(F.col("fold"), F.col("b_fold"), F.col("size"), F.col("b_size"))
    return both.filter(possible & close).select(F.col("node").alias("a"), F.col("b_node").alias("b")).distinct()


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, root) once they are joined by further links (a, b): their stars stand for the links that made them."""
    return contract(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links), "a", "b")


def node_roots(rows: DataFrame, keyed: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, node) of each row, and (node, root) of each node that has a link."""
    firsts = [F.min(c).alias(c) for c in ("fp", "size")] + [F.first(c).alias(c) for c in ("prefix", "sketch")]
    nodes = scratch.write(rows.groupBy("node").agg(*firsts, F.min(F.struct("k1", "k2")).alias("row")), "nodes")
    members = scratch.write(rows.select("doc_id", "k1", "k2", "node"), "members")
    scratch.drop(nodes, "shingle-sets")
    tokens = nodes.select("node", "size", folded(F.col("sketch")).alias("fold"), F.posexplode("prefix").alias("pos", "token"))
    ends = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    hubs = scratch.write(ends.filter("hub <> last").select("token", "hub"), "hubs")
    scratch.drop(nodes)
    met = scratch.write(tokens.join(hubs.hint("merge"), "token"), "met")
    slim = scratch.write(nodes.drop("prefix"), "slim-nodes")
    scratch.drop(nodes, "hubs", "nodes")
    stars = met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = close_pairs(stars.unionByName(simhash_stars(slim)), slim)
    close = scratch.write(stars.groupBy("a").agg(F.min("b").alias("b")), "close")
    scratch.drop(met)
    first = scratch.write(verified(close, slim, keyed, width, scratch), "first-links")
    scratch.drop(met, "close", "full-sets")
    groups = contract(first, "a", "b")
    for turn in range(ROUNDS):
        close = scratch.write(close_pairs(hub_pairs(met, groups, turn), slim), "close")
        more = scratch.write(verified(close, slim, keyed, width, scratch), f"hub-links-{turn}")
        scratch.drop(met, "close", "full-sets")
        if not more.take(1):
            break
        groups = joined(groups, more)
    candidates = scratch.write(other_pairs(met, groups), "candidates")
    scratch.drop(met, "met")
    close = scratch.write(close_pairs(candidates, slim), "close")
    scratch.drop(slim, "candidates")
    rest = scratch.write(verified(close, slim, keyed, width, scratch), "other-links")
    scratch.drop(slim, "close", "full-sets", "slim-nodes")
    return members, joined(groups, rest)


def keep_one_of_each_group(docs: DataFrame, *, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each group: that with the smallest id (null last); one of equal rows."""
    small_batches(docs.sparkSession)
    doc, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = F.xxhash64(doc, text), F.coalesce(doc.cast("long"), F.lit(-1))
    keyed = docs.select(doc.cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    scratch = Scratch()
    members, roots = node_roots(set_rows(keyed, width, scratch), keyed, width, scratch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first")
    a, b = fresh(docs, "k1", "k2")
    keep = merge_join(members, roots, ["node"]).groupBy(F.coalesce("root", "node")).agg(first).select(F.col("first.k1").alias(a), F.col("first.k2").alias(b))
    return docs.withColumns({a: k1, b: k2}).join(keep, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
