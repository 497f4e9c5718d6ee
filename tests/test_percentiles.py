"""Exact percentiles without a sort, against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import quality as Q


def groups():
    rng = random.Random(2)
    made = {
        "flat": [rng.random() for _ in range(3000)],
        "heavy": [math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1]) for _ in range(2000)],
        "ties": [float(rng.randrange(3)) for _ in range(2500)],
        "near": [1e16 + 2 * rng.randrange(50) for _ in range(900)] + [-1e300, 1e300, 5e-324, 0.0, -5e-324],
        "huge": [1.7e308, -1.7e308] * 40 + [0.0] * 41,
        "special": [float("inf")] * 30 + [float("-inf")] * 25 + [rng.random() for _ in range(70)],
        "one": [4.5],
        "two": [1.0, 2.0],
    }
    return made


@pytest.mark.parametrize("bucket", [2, 10_000])
def test_ranks(spark, bucket):
    made = groups()
    made["odd"] = [float("nan")] * 20 + [1.0, float("-inf")] * 20
    values = spark.createDataFrame([(g, v) for g, vs in made.items() for v in vs], "g string, v double").repartition(5)
    wanted = [(g, r) for g, vs in made.items() for r in sorted({0, len(vs) - 1, len(vs) // 2, len(vs) // 3, int(len(vs) * 0.95)})]
    ranks = spark.createDataFrame(wanted, "g string, rank long").join(values.groupBy("g").agg(*Q.extent()), "g")
    got = Q.rank_values(values, ranks, "g", bucket, bins=16).collect()
    assert len(got) == len(wanted)
    for r in got:
        want = np.sort(np.array(made[r["g"]]))[r["rank"]]
        assert r["value"] == want or (math.isnan(want) and math.isnan(r["value"])), r


@pytest.mark.parametrize("bucket", [5])
def test_stats(spark, bucket):
    made = {g: v for g, v in groups().items() if g not in ("special", "huge", "heavy", "near")}
    rows = [(g, v) for g, vs in made.items() for v in vs] + [("one", None), (None, 1.0), ("none", None)]
    values = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["g"]: r for r in Q.latency_stats(values, "x", "g", bucket=bucket).collect()}
    assert set(got) == set(made)
    for g, vs in made.items():
        assert got[g]["samples"] == len(vs) and got[g]["min"] == pytest.approx(min(vs), abs=1e-4) and got[g]["max"] == pytest.approx(max(vs), abs=1e-4)
        assert got[g]["median"] == pytest.approx(np.percentile(vs, 50), abs=1e-4)
        assert got[g]["p95"] == pytest.approx(np.percentile(vs, 95), abs=1e-4)
    assert Q.latency_stats(values.limit(0), "x", "g").collect() == []


def test_values_are_not_sorted(spark):
    """A hundred thousand values: what is sorted at the end are a bucket's values only."""
    values = spark.range(100_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("x"))
    frame = Q.latency_stats(values, "x", "g", bucket=500)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    row, exact = frame.collect()[0], values.agg(F.expr("percentile(x, array(0.5, 0.95))").alias("p")).collect()[0]["p"]
    assert [row["median"], row["p95"]] == pytest.approx(exact)
