"""Decisions by expiry: rechecking those past it gives what rechecking all would, and reads a range of the stored order."""

import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import decisions as D
from accordant.plans import q_currency as Q
from accordant.plans.registry import Tables
from accordant.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def dated(t):
    return Q.dated_history(t)


def current(frame, *columns):
    return sorted(tuple(r) for r in frame.filter("is_current").select("entity_id", *columns).collect())


@pytest.mark.parametrize("as_of", [Q.FIRST, Q.SECOND, "2002-03-01 00:00:00"])
def test_due_ones_alone_give_what_all_give(t, dated, as_of):
    due = stored(D.due_decisions(dated, as_of), "due")
    every = Q.decided(t, as_of).drop("profile_id")
    some = Q.decided(t, as_of, due).drop("profile_id")
    assert current(D.recheck(dated, due, some), "valid") == current(D.still_current(dated, every), "valid")
    n = due.count()
    assert n == some.count() and (n == 0) == (as_of == Q.FIRST)


def test_changed_facts_are_due_before_their_time(spark, t, dated):
    some = dated.filter("is_current").select("entity_id").orderBy("entity_id").limit(3)
    due = D.due_decisions(dated, Q.FIRST, some)
    assert sorted(r[0] for r in due.collect()) == sorted(r[0] for r in some.collect())
    changed = Q.decided(t, Q.FIRST, due).drop("profile_id").withColumn("fingerprint", F.lit("v1|other"))
    checked = D.recheck(dated, due, changed)
    assert checked.filter("is_current and not valid").count() == 3


def test_the_scan_is_a_range(spark, dated):
    due = D.due_decisions(dated, Q.SECOND)
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(valid_until" in plan
    # Files hold disjoint ranges of the expiry.
    ranges = dated.filter("valid_until is not null").groupBy(F.input_file_name().alias("f")).agg(F.min("valid_until").alias("a"), F.max("valid_until").alias("b"))
    found = sorted((r["a"], r["b"]) for r in ranges.collect())
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_expiry_against_plain_python(spark):
    rng = random.Random(4)
    day = 86400
    claims = [(rng.randrange(30), f"f{rng.randrange(3)}", f"c{k}", rng.choice(["", "a"]), rng.randrange(100) * day, rng.choice(["r", None]), None, rng.random() < 0.9) for k in range(200)]
    lines = [(rng.randrange(30), f"g{rng.randrange(3)}", rng.choice(["P", "C"]), "P", rng.randrange(100) * day) for _ in range(120)]
    checks = [(e, rng.randrange(100) * day) for e in range(0, 30, 3)]
    frame = spark.createDataFrame(claims, "entity_id int, field string, claim_id string, value_key string, s long, raw_id string, verification_id string, active boolean")
    got = {
        r["entity_id"]: int(r["valid_until"].timestamp())
        for r in D.first_expiry(
            frame.withColumn("observed_at", F.timestamp_seconds("s")),
            spark.createDataFrame(lines, "entity_id int, independence_group string, raw_kind string, kind string, s long").withColumn("seen_at", F.timestamp_seconds("s")),
            spark.createDataFrame(checks, "entity_id int, s long").withColumn("checked_at", F.timestamp_seconds("s")),
            "1970-03-01 00:00:00", 20.0,
        ).collect()
    }
    limit, want = 59 * day - 20 * day, {}
    newest = {}
    for e, g, raw_kind, kind, s in lines:
        if raw_kind == kind:
            newest[e, g] = max(newest.get((e, g), 0), s)
    moments = [(c[0], c[4]) for c in claims if c[3] and c[5] and c[7]] + [(e, s) for (e, _), s in newest.items()] + checks
    for e, s in moments:
        if s >= limit:
            want[e] = min(want.get(e, s + 20 * day), s + 20 * day)
    assert got == want and len(want) > 10
