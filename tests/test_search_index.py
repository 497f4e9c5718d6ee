"""Substring search through the index against a scan."""

import random

import pytest

from accordant.operators.search_index import build_index


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij数据产品é", k=rng.randint(1, 8))) for _ in range(500)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, "", "Common Ltd", "COMMON AG"])) for k in range(3000)]
    rows[7] = (7, "the Only%one_\\here [x]", "Common Ltd")
    frame = spark.createDataFrame(rows, "id long, title string, company string").repartition(5)
    return build_index(frame, "id", ("title", "company")), rows


def hits(rows, term):
    return sorted(k for k, *texts in rows if any(t is not None and term.lower() in t.lower() for t in texts))


@pytest.mark.parametrize("term", ["common", "Common L", "only%ONE_\\h", "[x]", "数据", "数据产", "a", "é", "", "mm", "no such text", "mon"])
def test_search_equals_a_scan(indexed, term):
    index, rows = indexed
    assert sorted(r["id"] for r in index.search(term).collect()) == hits(rows, term)


def test_random_pieces_of_the_texts(indexed):
    index, rows = indexed
    rng = random.Random(1)
    for _ in range(8):
        title = rng.choice([r[1] for r in rows if len(r[1]) > 8])
        at = rng.randrange(len(title) - 5)
        term = title[at : at + rng.randint(3, 7)]
        assert sorted(r["id"] for r in index.search(term).collect()) == hits(rows, term)


def test_a_rare_term_has_few_candidates(indexed):
    index, rows = indexed
    assert index.candidates("only%one").count() == 1
    rare = [t for t in {r[1][:6] for r in rows if len(r[1]) >= 6} if len(hits(rows, t)) <= 3][:5]
    assert rare and all(index.candidates(t).count() < 0.05 * len(rows) for t in rare)
    assert "PushedFilters: [In(piece" in index.candidates("common")._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_index(spark, indexed):
    index = build_index(spark.createDataFrame([], "id long, title string"), "id", ("title",))
    assert index.search("abc").collect() == [] and index.search("a").collect() == []
