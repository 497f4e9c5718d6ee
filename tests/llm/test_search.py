"""Ranked search against one text at a time."""

import collections
import math
import random

import numpy as np
import pytest

from accordant.llm import ranked_search as S
from tests.llm import plain


def terms(text):
    return plain.ITEM_WORDS.findall((text or "").translate(plain.LOWER))


def ranked(rows, items, k):
    """rows, items: (id, text). Sorted lists of (item, rank, id, score)."""
    counts = [(i, collections.Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(x for _, c in counts for x in c)
    own = collections.defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    out = []
    for item, words in own.items():
        weights = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in words}
        found = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            found.append((-sum(w * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x, w in weights.items()), i))
        best = sorted(f for f in found if f[0] < 0)[:k]
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def with_null_last(rows):
    """A null id is the largest."""
    return [(float("inf") if i is None else i, t) for i, t in rows]


@pytest.mark.parametrize("cells", [1, 300, S.CELLS])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_against_a_plain_ranking(spark, docs, rows, k, cells):
    """Nulls, copies, long texts and repeated rows; blocks of one item, of a few, and of all."""
    items = [(1, rows[0][1][:200]), (2, rows[3][1]), (2, rows[7][1].upper()), (3, None), (4, ""), (5, "zzzz unknown"), (None, rows[10][1][:60]), (6, "é😀 wide")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    want = [(i, r, None if d == float("inf") else d, s) for i, r, d, s in ranked(with_null_last(rows), items, k)]
    assert got(S.rank_documents(docs, frame, k, cells=cells)) == want
    assert {x[0] for x in want} == {1, 2, None, 6}


def test_on_the_tables(spark, sf, sf_rows):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    frame = S.rank_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got(frame) == ranked(sf_rows, items, 50)


def test_many_ties(spark):
    """Hundreds of copies over many partitions: of equal scores the smallest ids stay."""
    copies = [(k, "alpha beta") for k in random.Random(1).sample(range(10_000), 600)]
    rows = copies + [(20_000 + k, "gamma delta epsilon") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    frame = S.rank_documents(docs, spark.createDataFrame([(0, "alpha gamma")], "item_id int, text string"), 40)
    assert got(frame) == ranked(rows, [(0, "alpha gamma")], 40)


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for a, b in ((none, items), (docs, items.limit(0)), (none, items.limit(0))):
        frame = S.rank_documents(a, b)
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.collect() == []


def test_sums_stay_exact():
    """Tiles never sum to 2^53, cover all terms once, and large weights shrink them."""
    rng = np.random.default_rng(3)
    for top in (10, 30_000, 10**9):
        weight = rng.integers(0, top, 5000)
        tiles = list(S.column_tiles(weight))
        assert np.array_equal(np.concatenate([np.arange(5000)[t] for t in tiles]), np.arange(5000))
        assert all(int(weight[t].sum()) * S.IMPACT_LIMIT < S.EXACT and t.stop - t.start <= S.COLUMNS for t in tiles)
    assert len(list(S.column_tiles(np.full(100, 5 * 10**9)))) == 100
    with pytest.raises(ValueError):
        list(S.column_tiles(np.array([10**10])))


def test_tiles_add_to_the_same_scores(rows, monkeypatch):
    """Products of three terms at a time give what one product gives."""
    block = S.ItemBlock()
    for i, (_, t) in enumerate(rows[:20]):
        block.add(i, sorted({x.encode() for x in terms(t)}))
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len((t or "").encode()) for _, t in rows])
    words = S.read_words(data, offsets)
    found = S.Finder(list(block.terms)).find(words)
    block.weights = np.random.default_rng(1).integers(1, 20_000, len(block.terms))
    whole = S.tile_scores(block, block.matrix(block.weights), words, found, (50, 40_000))
    monkeypatch.setattr(S, "column_tiles", lambda weight: (slice(a, min(a + 3, len(weight))) for a in range(0, len(weight), 3)))
    again = S.tile_scores(block, block.matrix(block.weights), words, found, (50, 40_000))
    assert np.array_equal(whole[0], again[0]) and np.array_equal(whole[1], again[1])


def test_length_norm_beyond_64_bits():
    count = np.array([1, 10**9, 10**12])
    assert S.length_norm(count, 10**10, 10**14).tolist() == [50 + 50 * c * 10**10 // 10**14 for c in count.tolist()]
