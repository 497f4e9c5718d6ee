"""Substring dedup, SimHash groups and decontamination."""

import collections
import random

import numpy as np
import pytest

from accordant.llm import decontaminate, queries, simhash, substrings
from accordant.llm.words import ALNUM, Words
from tests.llm import plain


def as_words(text, table=None):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), *([table] if table is not None else []))


def test_words_of_neighbouring_texts_do_not_join():
    raw = np.frombuffer(b"ab cdef", np.uint8)
    words = Words(raw, np.array([0, 1, 1, 5, 7]))
    assert list(zip(words.start, words.end)) == [(0, 1), (1, 2), (3, 5), (5, 7)]
    assert words.count.tolist() == [1, 0, 2, 1]
    assert as_words("a é1 ,b", ALNUM).count.tolist() == [3]


@pytest.mark.parametrize("window, seed", [(35, 8), (6, 2), (3, 3), (1, 1)])
def test_substrings(docs, rows, none, window, seed):
    got = substrings.removal_report(docs, window=window, seed=seed).collect()
    want = plain.removed([t for _, t in rows], window)
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, *x) for (i, _), x in zip(rows, want))
    assert substrings.removal_report(none, window=window, seed=seed).count() == 0


@pytest.mark.parametrize("case", range(3))
def test_substrings_of_few_words(spark, case):
    """Texts over two or three different words: every minimizer branches, runs overlap themselves."""
    rng = random.Random(case)
    texts = [" ".join(rng.choices("ab" if case else "abc", k=rng.randint(0, 60))) for _ in range(60)] + ["a " * 90, "a b " * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.removal_report(frame, window=9, seed=3).collect()}
    assert [got[k] for k in range(len(texts))] == plain.removed(texts, 9)


def test_removed_spans_and_text(docs, rows):
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain.removed([t for _, t in rows])))
    got = substrings.remove_repeats(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], plain.sha(r["text"])) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_op3(spark, sf, sf_rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op3_substring_dedup"](spark, sf).collect()}
    assert [got[i] for i, _ in sf_rows] == plain.removed([t for _, t in sf_rows])


def groups_of(rows, width):
    prints = [plain.fingerprint(t, width) for _, t in rows]
    group = plain.components(prints)
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return prints, group, least


@pytest.mark.parametrize("width", [3, 5])
def test_simhash_groups(docs, rows, none, width):
    prints, group, least = groups_of(rows, width)
    want = collections.Counter((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicate_report(docs, width=width).collect()) == want
    assert simhash.near_duplicate_report(none, width=width).count() == 0


def test_links_of_any_fingerprints(spark):
    """Fingerprints around a few centres, with the sign bit and zero among them, against all pairs."""
    rng = random.Random(2)
    centres = [0, 1 << 63, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(20))]
    prints = set(centres)
    for c in centres:
        for _ in range(30):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    rooted = {r["fp"]: r["root"] for r in simhash.rooted(frame).collect()}
    group = plain.components(prints)
    pairs = {(group[k], rooted[p]) for k, p in enumerate(signed)}
    assert len(pairs) == len(set(group)) == len({r for _, r in pairs})


def test_cells_and_dense_cells(spark):
    """Pairs far apart are found in their grid cells; a crowd around one value is in cells that are split."""
    rng = random.Random(6)
    apart = [(p, p ^ (1 << rng.randrange(31)) ^ (1 << 40)) for p in (rng.getrandbits(63) for _ in range(50))]
    centre = rng.getrandbits(63)
    crowd = sorted({centre, *(centre ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(14) if a != b)})
    frame = spark.createDataFrame([(p,) for p in {*crowd, *(p for pair in apart for p in pair)}], "fp long")
    cells = simhash.grid_cells(frame)
    found = {frozenset(r) for r in simhash.pairs_in_cells(cells).collect()}
    assert set(map(frozenset, apart)) <= found
    dense = {r["fp"] for r in cells.filter(f"n > {simhash.DENSE}").select("fp").distinct().collect()}
    assert len(dense) > len(crowd) / 2
    roots = {r["fp"]: r["root"] for r in simhash.rooted(frame).collect()}
    assert {roots[p] for p in crowd} == {min(crowd)} and all(roots[a] == roots[b] for a, b in apart)


def test_one_of_each_group_stays(docs, rows, none):
    _, group, least = groups_of(rows, 3)
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = sorted(str(least.get(g)) for g in set(group))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert simhash.keep_one_of_each_group(none).count() == 0


def test_op5(spark, sf, sf_rows):
    prints, group, least = groups_of(sf_rows, 3)
    want = {(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(sf_rows, prints, group)}
    assert {tuple(r) for r in queries.QUERIES["op5_simhash_groups"](spark, sf).collect()} == want


@pytest.fixture(scope="module")
def items(rows, spark):
    texts = {i: t for i, t in rows if t}
    found = [(1, texts[3][:120]), (2, texts[3][:120].upper()), (3, None), (4, " .,; "), (5, "one, TWO"), (6, texts[9]), (None, texts[12][20:150]), (7, "x y z")]
    return found, spark.createDataFrame(found, "item_id long, text string")


@pytest.mark.parametrize("max_windows", [1_000_000, 20])
def test_decontamination(docs, rows, none, items, max_windows):
    plain_items, benchmark = items
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain.hits([t for _, t in rows], plain_items)))
    got = decontaminate.hit_report(docs, benchmark, max_windows=max_windows).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert decontaminate.hit_report(none, benchmark, max_windows=max_windows).count() == 0


def test_no_items(docs, rows, items):
    got = decontaminate.hit_report(docs, items[1].limit(0)).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] for r in got)


def test_hits_are_removed(docs, rows, items):
    plain_items, benchmark = items
    hits = plain.hits([t for _, t in rows], plain_items)
    kept = decontaminate.remove_hits(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for (i, _), x in zip(rows, hits) if not x[4])
    cut = decontaminate.remove_hits(docs, benchmark, whole_documents=False).collect()
    left = collections.Counter((i, x[0] - x[1]) for (i, _), x in zip(rows, hits))
    assert collections.Counter((r["doc_id"], len(plain.ITEM_WORDS.findall((r["text"] or "").translate(plain.LOWER)))) for r in cut) == left


def test_op9(spark, sf, sf_rows):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_decontamination"](spark, sf).collect()}
    assert [got[i] for i, _ in sf_rows] == plain.hits([t for _, t in sf_rows], items)
