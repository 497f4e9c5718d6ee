"""Hot keys: labels agree with plain Python, plans stay free of cross joins, groups of copies stay linear."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import claims as C, decisions as D, graph, pairs as P
from accordant.rules import DecisionRules, PairRules
from accordant.session import fact_join, first_per_group, number_rows


def skewed_claims(spark):
    """A third of all claims belongs to one entity; some are inactive, empty or out of scope."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("entity_id"),
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("field"),
        F.concat(F.lit("s"), (F.hash("id") % 5).cast("string")).alias("source_key"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("claim_id"),
        F.when(F.col("id") % 11 == 0, "").otherwise((F.hash("id", F.lit(1)) % 3).cast("string")).alias("value_key"),
        (F.pmod(F.hash("id", F.lit(2)), F.lit(3)) * 10).cast("int").alias("authority"),
        F.timestamp_seconds(F.pmod(F.hash("id", F.lit(3)), F.lit(50))).alias("observed_at"),
        (F.col("id") % 13 != 0).alias("active"),
        (F.col("id") % 17 != 0).alias("applicable"),
    )
    return rows.withColumns({"created_at": F.col("observed_at"), "raw_value": F.col("value_key")})


def test_labels_against_plain_python(spark):
    claims = skewed_claims(spark)
    rows = [r.asDict() for r in claims.collect()]
    want = {}
    usable = [r for r in rows if r["active"] and r["applicable"]]
    for _, group in itertools.groupby(sorted(usable, key=lambda r: (r["entity_id"], r["field"])), key=lambda r: (r["entity_id"], r["field"])):
        group = list(group)
        full = [r for r in group if r["value_key"]]
        newest = {}
        for r in full:
            key = (r["observed_at"], r["created_at"], r["claim_id"])
            if r["source_key"] not in newest or key > newest[r["source_key"]][0]:
                newest[r["source_key"]] = (key, r)
        current = [r for _, r in newest.values()]
        top = max((r["authority"] for r in current), default=None)
        best = [r for r in current if r["authority"] == top]
        split = len({r["value_key"] for r in best}) > 1
        chosen = max(best, key=lambda r: (r["observed_at"], r["created_at"], r["claim_id"]), default=None)
        for r in group:
            if not full:
                label = "all_missing"
            elif not r["value_key"]:
                label = ""
            elif r not in current:
                label = "superseded"
            elif split:
                label = "conflict" if r["authority"] == top else "higher_authority_unresolved"
            elif r is chosen:
                label = "selected"
            elif r["value_key"] == chosen["value_key"]:
                label = "agrees"
            else:
                label = "overridden"
            want[r["claim_id"]] = label
    got = {r["claim_id"]: r["reason"] for r in C.resolve_claims(claims).filter("active and applicable").collect()}
    assert got == want


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(n, f"k{rng.randrange(80)}") for n in range(120)] + [(n, "hot") for n in range(0, 120, 3)]
    edges += [(200 + i, f"chain{i}") for i in range(40)] + [(201 + i, f"chain{i}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for node, key in edges:
        parent[find(("k", key))] = find(("n", node))
    groups = {}
    for node, _ in edges:
        groups.setdefault(find(("n", node)), set()).add(node)
    want = {n: min(g) for g in groups.values() for n in g}
    got = graph.connect(spark.createDataFrame(edges, "node long, key string"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b, 1):
            new.append(row[j - 1] + 1 if ch == other else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_pairs_cover_brute_force(spark):
    """Every pair the rule keeps is an edge or follows from the stars and linked contents."""
    rng = random.Random(3)
    words = ["data", "product", "manager", "intern", "senior", "engineer", "analyst"]
    rows = []
    for i in range(60):
        title = " ".join(rng.sample(words, 2)) + rng.choice(["", " x", " (b)"])
        rows.append((i, "o", "POSTING", title, rng.sample(["a", "b", "c"], rng.randrange(3)), rng.sample(["2026", "2027"], rng.randrange(3)), rng.choice(["", "autumn", "spring"]), None, None, i % 4 != 0))
    schema = "entity_id long, org_id string, kind string, title string, cities array<string>, graduation_years array<string>, recruitment_type string, official_job_id string, identity_hint string, is_new_weak boolean"
    frame = spark.createDataFrame(rows, schema)
    rules = PairRules()
    want = set()
    for x, y in itertools.combinations(rows, 2):
        a, b = x[3].replace(" ", ""), y[3].replace(" ", "")
        title = 2 * lcs(a, b) / (len(a) + len(b))

        def jac(p, q):
            p, q = set(p), set(q)
            return 1.0 if not p and not q else (0.0 if not p or not q else len(p & q) / len(p | q))

        score = 0.55 * title + 0.2 * jac(x[4], y[4]) + 0.15 * jac(x[5], y[5]) + (0.1 if x[6] and x[6] == y[6] else 0)
        if score >= rules.keep_score - 1e-12 and (x[9] or y[9]):
            want.add((x[0], y[0]))
    content = {r["entity_id"]: r for r in P.contents(frame).collect()}
    groups = P.content_groups(P.contents(frame))
    linked = {(r["left_id"], r["right_id"]) for r in P.candidate_pairs(frame).collect()}
    lead = {r["content_id"]: r["entity_id"] for r in groups.collect()}
    hub = {}
    for e, r in content.items():
        if r["batch"]:
            hub.setdefault((r["title_key"], tuple(r["years"]), r["batch"]), set()).add(r["content_id"])

    def hub_lead(r):
        return lead[min(hub[(r["title_key"], tuple(r["years"]), r["batch"])])] if r["batch"] else None

    def follows(a, b):
        x, y = content[a], content[b]
        if x["content_id"] == y["content_id"]:
            return True
        if x["batch"] and (x["title_key"], x["years"], x["batch"]) == (y["title_key"], y["years"], y["batch"]):
            return True
        edges = [(lead[x["content_id"]], lead[y["content_id"]]), (hub_lead(x), hub_lead(y))]
        return any(None not in e and tuple(sorted(e)) in linked for e in edges)

    missing = [p for p in want if not follows(*p)]
    assert want and not missing


def test_copies_make_a_star(spark):
    frame = spark.range(300).select(
        F.col("id").alias("entity_id"), F.lit("o").alias("org_id"), F.lit("POSTING").alias("kind"), F.lit("same title").alias("title"),
        F.array(F.lit("x")).alias("cities"), F.array().cast("array<string>").alias("graduation_years"), F.lit("b").alias("recruitment_type"),
        F.lit(None).cast("string").alias("official_job_id"), F.lit("h").alias("identity_hint"), F.lit(True).alias("is_new_weak"),
    )
    found = P.candidate_pairs(frame)
    assert found.count() == 299
    assert found.agg(F.min("score")).collect()[0][0] == pytest.approx(1.0)


def test_helpers_on_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = fact_join(rows, facts, ["k"])
    assert joined.count() == 5000 and joined.filter("n is null").count() == 0
    best = first_per_group(rows, ["k"], [F.col("id").desc()], 2)
    assert best.filter("k = 'hot'").count() == 2
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    numbered = number_rows(rows, [F.col("id").asc()], group="k")
    assert [r["row_number"] for r in numbered.filter("k = 'hot'").orderBy("id").collect()] == list(range(1, 1668))
    whole = number_rows(rows, [F.col("id").desc()])
    assert {r["id"]: r["row_number"] for r in whole.collect()} == {i: 5000 - i for i in range(5000)}


def test_decision_axes(spark):
    """Boundaries of trust: the exact age limit is fresh, an unresolved check is not a closure."""
    context = spark.createDataFrame(
        [
            ("edge", "OPEN", "2026-07-27 00:00:00", 2, True, []),
            ("late", "OPEN", "2026-07-26 23:59:59", 2, True, []),
            ("blocked", "BLOCKED", None, 1, False, []),
            ("torn", "OPEN", "2026-08-09 00:00:00", 2, True, ["deadline"]),
            ("many", "UNKNOWN", None, 2, False, []),
            ("one", "UNKNOWN", None, 1, False, []),
            ("split", "UNKNOWN", None, 2, False, ["deadline"]),
        ],
        "entity_id string, verification_result string, official_checked_at string, source_count int, official_specific_posting boolean, conflicting_fields array<string>",
    ).withColumns(
        {
            "official_checked_at": F.col("official_checked_at").cast("timestamp"),
            "latest_source_at": F.lit("2026-08-09 00:00:00").cast("timestamp"),
        }
    )
    got = context.select("entity_id", D.trust("2026-08-10 00:00:00", DecisionRules())["result"].alias("t")).collect()
    assert {r["entity_id"]: r["t"] for r in got} == {
        "edge": "VERIFIED", "late": "STALE", "blocked": "UNKNOWN", "torn": "VERIFIED_WITH_CONFLICT",
        "many": "CONSISTENT", "one": "UNKNOWN", "split": "CONFLICTED",
    }


def test_few_candidates_among_many_titles(spark):
    """1,200 different titles of one block: those that reach the floor are found among few candidates."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(300)]
    rows = {}
    while len(rows) < 1200:
        title = "".join(rng.choices(words, k=rng.randint(3, 5)))
        for variant in (title, title[:-1] + "x") if rng.random() < 0.3 else (title,):
            rows[variant] = ([f"city{rng.randrange(40)}"], [str(rng.randrange(2024, 2027))], rng.choice(["", "spring", "autumn"]))
    listed = [("o", "k", t, *v, True) for t, v in rows.items()]
    groups = spark.createDataFrame(listed, "org_id string, kind string, title_key string, cities array<string>, years array<string>, batch string, has_new boolean")
    rules = PairRules()
    got = {(r["left_title"], r["right_title"]): r["title_similarity"] for r in P.similar_titles(groups, rules).collect()}
    want = {}
    for (a, (ca, ya, ba)), (b, (cb, yb, bb)) in itertools.combinations(sorted(rows.items()), 2):
        floor = None
        if ba and ba == bb and (ca == cb or ya == yb):
            floor = P.title_floor(rules, True)
        elif ca == cb:
            floor = P.title_floor(rules, False)
        if floor is not None and 2 * sum((Counter(a) & Counter(b)).values()) >= floor * (len(a) + len(b)):
            ratio = 2 * lcs(a, b) / (len(a) + len(b))
            if ratio >= floor - 1e-9:
                want[a, b] = ratio
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    met = P.title_pairs_met(groups, rules).count()
    assert met < 0.05 * len(rows) * (len(rows) - 1) / 2


def test_all_titles_of_one_block(spark):
    """5,000 different titles of one block and city, some of one or two characters, against all pairs."""
    rng = random.Random(21)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 7))) for _ in range(700)]
    titles = {"".join(c) for c in itertools.product("xyz", repeat=2)} | {"x", "y", "aaaa", "aaaaa", "aaaaab"}
    while len(titles) < 5000:
        title = "".join(rng.choices(words, k=rng.randint(1, 4)))
        titles |= {title, title[1:] + title[0]} if rng.random() < 0.1 else {title}
    titles = sorted(titles)[:5000]
    fresh = [rng.random() < 0.9 for _ in titles]
    groups = spark.createDataFrame(
        [("o", "k", t, ["c"], [], "b", f) for t, f in zip(titles, fresh)],
        "org_id string, kind string, title_key string, cities array<string>, years array<string>, batch string, has_new boolean",
    )
    floor = P.title_floor(PairRules(), True)
    letters = sorted({c for t in titles for c in t})
    counts = np.array([[t.count(c) for c in letters] for t in titles], np.int16)
    sizes = counts.sum(axis=1)
    want = {}
    for a in range(len(titles)):
        shared = np.minimum(counts[a], counts[a + 1 :]).sum(axis=1)
        for b in np.flatnonzero(2 * shared >= floor * (sizes[a] + sizes[a + 1 :]) - 1e-9) + a + 1:
            ratio = 2 * lcs_bits(titles[a], titles[b]) / (sizes[a] + sizes[b])
            if ratio >= floor - 1e-9 and (fresh[a] or fresh[b]):
                want[titles[a], titles[b]] = ratio
    got = P.similar_titles(groups).collect()
    assert len(got) == len(want) > 5000
    assert all(abs(want[r["left_title"], r["right_title"]] - r["title_similarity"]) < 1e-9 for r in got)


def lcs_bits(a, b):
    """Longest common subsequence with one bit for each character of b."""
    full, masks = (1 << len(b)) - 1, {}
    for k, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << k
    v = full
    for c in a:
        hit = v & masks.get(c, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(b) - v.bit_count()


def test_candidates_in_few_exchanges(spark, monkeypatch):
    """All steps together shuffle fewer than 40 times and read the entities once."""
    from accordant.operators import pairs

    plans, stored = [], pairs.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(pairs, "stored", watched)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    entities = part.selectExpr(
        "p_partkey AS entity_id", "p_brand AS org_id", "'k' AS kind", "p_name AS title", "array(cast(p_size AS string)) AS cities",
        "cast(array() AS array<string>) AS graduation_years", "p_type AS recruitment_type", "cast(null AS string) AS official_job_id",
        "cast(null AS string) AS identity_hint", "true AS is_new_weak",
    )
    plans.append(pairs.candidate_pairs(entities)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("Exchange ") for p in plans) < 40
    assert sum(p.count("part.parquet") for p in plans) == 1
