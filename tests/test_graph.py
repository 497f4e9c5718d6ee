"""Components by contraction, against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import graph
from accordant.session import delete_path


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


@pytest.fixture()
def rounds(monkeypatch):
    """Working sets that the rounds began with."""
    seen, large = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda live: seen.append(live.count()) or large(live))
    return seen


def test_mixed_components(spark, rounds):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000, 1000 + k) for k in range(1, 300)]  # one hot node
    edges += [(5000 + k, 5001 + k) for k in range(200)] + [(7000, 7000), (8001, 8000), (8000, 8001)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.contract(spark.createDataFrame(edges, "left_id long, right_id long")).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])
    # Finished components leave: what is left goes down to the chain.
    assert all(a >= b for a, b in zip(rounds, rounds[1:])) and rounds[-1] < rounds[0] / 2


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    found = graph.contract(chain)
    assert found.count() == n + 1 and found.filter("root <> 0").count() == 0
    assert len(rounds) <= 20


def test_text_ids_and_no_edges(spark):
    edges = spark.createDataFrame([("b", "c"), ("d", "c"), ("x", "y")], "left_id string, right_id string")
    assert {(r["node"], r["root"]) for r in graph.contract(edges).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")}
    assert graph.contract(edges.limit(0)).collect() == []


def test_only_scratch_is_deleted(spark, tmp_path):
    with pytest.raises(ValueError):
        delete_path(spark, str(tmp_path))
