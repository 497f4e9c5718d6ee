"""The filter audit against filters applied one after the other."""

import collections
import itertools
import re

import pytest

from accordant.llm import filter_audit as A
from tests.llm import plain


def failures(rows):
    """rows: (id, text). The letters that each row fails."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t in rows:
        t = t or ""
        w = plain.words(t)
        checks = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and least[t] < i,
        }
        out.append({k for k, failed in checks.items() if failed})
    return out


def plain_audit(rows, labels):
    """rows: (part, id, text); labels: id -> (quality, toxic)."""
    failed = failures([r[1:] for r in rows])
    parts = collections.defaultdict(list)
    for (part, i, _), f in zip(rows, failed):
        parts[part or ""].append((f, *labels.get(i, (0, 0))))
    out = []
    for part, docs in parts.items():
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in docs)
                shapley[letter] += len(gone)
                lines.append(
                    [part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in docs),
                     sum(d[1] == 1 for d in gone), sum(d[2] == 1 for d in gone), letter]
                )
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_against_filters_in_turn(spark, docs, rows):
    labels = {k: (k % 3, k % 2) for k in range(0, 52, 2)}
    frame = spark.createDataFrame([(k, *v, "x") for k, v in labels.items()], "doc_id long, quality int, toxic int, mask string")
    frame = frame.unionByName(spark.createDataFrame([(4, 0, 0, "again"), (None, 1, 1, "null"), (6, None, None, "y")], frame.schema))
    parted = docs.selectExpr("*", "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN 'p' ELSE 'q' END AS source", "1 AS mask", "2 AS good")
    known = [(r["source"], r["doc_id"], r["text"]) for r in parted.collect()]
    got = A.audit_report(parted, frame)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(known, labels)


def test_on_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    rows = [(r["source"], r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, A.audit_report(docs, labels).collect())) == plain_audit(rows, known)


def test_all_masks_and_fewer_letters(spark):
    """Every mask of three filters, and one filter alone."""
    rows = spark.createDataFrame([("p", m, m % 2 == 0, False) for m in range(8) for _ in range(m + 1)], "part string, mask int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): r for r in A.audit(rows, "XYZ").collect()}
    assert len(got) == 18
    for (order, step), r in got.items():
        bits = [1 << "XYZ".index(c) for c in order]
        before, bit = sum(bits[: step - 1]), bits[step - 1]
        assert r["removed"] == sum(m + 1 for m in range(8) if m & bit and not m & before)
        assert r["kept"] == sum(m + 1 for m in range(8) if not m & (before | bit))
        assert r["unique_fails"] == bit + 1
    one = A.audit(rows.filter("mask < 2"), "X").collect()
    assert [(r["kept"], r["removed"], r["shapley"]) for r in one] == [(1, 2, 2)]
    for bad in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            A.audit(rows, bad)


def test_more_parts_than_the_limit_of_recursion_allows(spark):
    """4,000 parts are 1.3 million rows of recursion."""
    rows = spark.range(4000).selectExpr("CAST(id AS STRING) AS part", "CAST(id % 32 AS INT) AS mask", "true AS good", "false AS toxic")
    assert A.audit(rows).count() == 4000 * 600


def test_empty_tables(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    parted = docs.selectExpr("*", "'s' AS source")
    assert A.audit_report(parted.limit(0), labels).collect() == []
    assert {r["good_lost"] for r in A.audit_report(parted, labels).collect()} == {0}
