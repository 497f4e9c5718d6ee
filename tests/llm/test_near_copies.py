"""Near copies by shingle similarity, against all pairs."""

import random

import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from accordant.llm import near_copies, simhash
from accordant.operators import graph
from accordant.session import checkpoint, scratch_path
from tests.llm import plain


def shingles(text, width=5):
    w = plain.words((text or "").translate(plain.LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def kept_by_all_pairs(rows):
    """The smallest id of each group of texts at 4/5, and the similar pairs that are no copies."""
    sets = [shingles(t) for _, t in rows]
    group, near = list(range(len(rows))), set()

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                group[find(a)] = find(b)
                if sets[a] != sets[b]:
                    near.add((rows[b][0], rows[a][0]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values()), near


def test_stage_finds_near_copies_that_are_no_copies(spark):
    """Words of a text replaced, so that similarities lie around 0.8; no pair is an exact copy."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for length in (6, 30, 60, 120, 400):
        for _ in range(4):
            base = rng.choices(vocabulary, k=length)
            for copy in range(6):
                text = list(base)
                at = rng.randrange(length)
                for k in range(at, min(length, at + copy * length // 60 + (copy > 0))):
                    text[k] = rng.choice(vocabulary)
                rows.append((len(rows), " ".join(text) + " tail" * (copy == 5)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, near = kept_by_all_pairs(rows)
    assert len(near) > 50
    got = sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, frame, "").collect())
    assert got == want


def test_stage_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    want, near = kept_by_all_pairs([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert near
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each_group(documents).collect()) == want


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text whose similarities lie around 0.8: candidates grow with the copies, and the groups are those of all pairs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for copy in range(240):
        text = list(base)
        for k in rng.sample(range(30), 1 + (copy % 8 > 0)):
            text[5 * k + 2] = f"n{copy}x{k}"
        rows.append((copy, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, write = [], near_copies.Scratch.write

    def counted(self, df, name):
        table = write(self, df, name)
        if name in ("candidates", "close"):
            found.append(table.count())
        return table

    monkeypatch.setattr(near_copies.Scratch, "write", counted)
    want, near = kept_by_all_pairs(rows)
    assert len(near) > 10 * len(rows)
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each_group(frame).collect()) == want
    assert sum(found) < 10 * len(rows)


def test_groups_are_joined_by_further_links(spark):
    """Stars of the groups and the new links give the components of all links, without the old links."""
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 40, (30, 2)) if a != b]
    old, new = (spark.createDataFrame(x, "a long, b long").coalesce(1) for x in (links[:15], links[15:]))
    want = sorted(map(tuple, near_copies.contract(old.unionByName(new), "a", "b").collect()))
    assert sorted(map(tuple, near_copies.joined(near_copies.contract(old, "a", "b"), new).collect())) == want


def test_no_join_of_fingerprints_broadcasts(spark, monkeypatch):
    """Spark sizes exploded cells as it does the fingerprints before them, so it would send all of them through the driver."""
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df) or write(self, *a, **b))
    monkeypatch.setattr(graph, "checkpoint", lambda df: plans.append(df) or checkpoint(df))
    path = scratch_path(spark, "fps")
    spark.range(2000).select(F.xxhash64(F.col("id") % 1900).alias("fp")).write.parquet(path)
    found = simhash.rooted(spark.read.parquet(path))
    assert found.count() == 2000
    joined = [p for df in [*plans, found] if "Join" in (p := df._jdf.queryExecution().executedPlan().toString())]
    assert len(joined) >= 3 and not [p for p in joined if "Broadcast" in p]
