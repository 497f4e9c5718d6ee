"""Claims cross one exchange by entity; entities too large for a task go another way with the same labels."""

from pyspark.sql import functions as F

from accordant.operators import claims as C, state as ST
from accordant.session import split_hot
from test_scale import skewed_claims


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def odd_claims(spark):
    """Skewed claims, some without entity, source, value or flag."""
    n = F.pmod(F.hash("claim_id", F.lit(9)), F.lit(40))
    gaps = {"entity_id": 0, "source_key": 1, "value_key": 2, "applicable": 3, "active": 4, "field": 5}
    claims = skewed_claims(spark)
    return claims.withColumns({c: F.when(n != k, F.col(c)) for c, k in gaps.items()})


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_claims_cross_one_exchange(spark):
    claims = skewed_claims(spark)
    assert exchanges(C.resolve_claims(claims)) == 1
    assert exchanges(C.verdicts(claims)) == 1
    assert exchanges(C.resolve_claims(claims).groupBy("field", "reason", "entity_id").count()) == 1


def test_hot_entities_get_the_same_labels(spark):
    for claims in (skewed_claims(spark), odd_claims(spark)):
        claims = claims.localCheckpoint()
        dealt, hot = split_hot(claims, "entity_id", floor=1000)
        assert 1900 < hot.count() < 3000 and dealt.count() + hot.count() == 6000
        assert rows_of(C.resolve_claims(claims)) == rows_of(C.resolve_claims(claims, floor=1000)) == rows_of(C._resolve_hot(claims))
        assert rows_of(C.verdicts(claims)) == rows_of(C.verdicts(claims, floor=1000))
        assert rows_of(C.latest_per_source(claims)) == rows_of(C.latest_per_source(claims, floor=1000))


def test_refresh_keeps_the_rest(spark):
    claims = odd_claims(spark).withColumns({"selected": F.lit(False), "reason": F.lit("old")}).localCheckpoint()
    keys = spark.createDataFrame([(3,), (3,), (None,)], "entity_id long")
    got = C.refresh_claims(claims, keys)
    want = C.resolve_claims(claims.filter("entity_id = 3")).unionByName(claims.filter("entity_id <> 3 or entity_id is null"))
    assert rows_of(got.select(claims.columns)) == rows_of(want.select(claims.columns))


def test_state_lines_are_dealt_as_buckets(spark):
    claims = skewed_claims(spark)
    lines = ST.source_state(claims, parts=7)
    assert exchanges(lines.repartition(7, "entity_id")) == 1
    assert rows_of(ST.source_state(claims, floor=1000)) == rows_of(lines)


def test_rows_cross_the_exchange_before_their_claims_are_made(spark):
    rows = odd_claims(spark).localCheckpoint()

    def make(lines):
        keep = [c for c in lines.columns if c not in ("field", "value_key", "raw_value", "claim_id")]
        values = {name: (F.col("value_key"), F.concat("value_key", F.lit(name))) for name in ("a", "b", "c")}
        return C.unpivot_claims(lines, keep + [F.col("claim_id").alias("line")], values).withColumn("claim_id", F.concat_ws(":", "line", "field"))

    given = C.RowClaims(rows, "entity_id", make, 3)
    claims = given.made().localCheckpoint()
    for step in (C.resolve_claims, C.verdicts, C.latest_per_source):
        plan = step(given)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
        # 3,000 claims are 1,000 rows: some entities are set apart.
        assert rows_of(step(given, floor=3000)) == rows_of(step(claims))


def test_rechecked_decisions_deal_out_lines_before_their_claims(spark, tmp_path):
    from accordant.plans import q_currency as Q
    from accordant.plans.registry import Tables

    lines = spark.range(40).selectExpr(
        "id AS l_orderkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "nullif(id % 5, 4) AS l_partkey", "id % 3 AS l_suppkey",
        "timestamp'1998-01-01' + make_dt_interval(cast(id AS int)) AS l_shipdate", "if(id % 2 = 0, 'A', 'R') AS l_returnflag", "'O' AS l_linestatus",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    t, keys = Tables(spark, str(tmp_path)), spark.createDataFrame([(1,), (2,), (2,), (None,)], "entity_id long")
    got = C.resolve_claims(Q.said_rows(t).of(keys))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(l_partkey")
    assert rows_of(got) == rows_of(C.resolve_claims(Q.said(t).filter("entity_id in (1, 2)"))) != []


def test_claims_meet_only_the_evidence_they_name(spark):
    claims = spark.createDataFrame(
        [(1, "a", "r1", None), (1, "b", "r2", None), (2, "c", None, "v1"), (2, "d", None, "v2"), (3, "e", None, None), (9, "f", "r1", None), (1, "g", "r9", "v1"), (None, "h", "r1", None), (2, "i", "r1", "v1")],
        "entity_id long, claim_id string, raw_id string, verification_id string",
    ).selectExpr("*", "'title' AS field", "'s' AS source_key", "'x' AS value_key", "1 AS authority", "timestamp'2020-01-01' AS observed_at", "timestamp'2020-01-01' AS created_at", "true AS active")
    raw = spark.createDataFrame([("r1", "POSTING"), ("r1", "CAMPAIGN"), ("r2", "CAMPAIGN")], "raw_id string, kind string")
    checks = spark.createDataFrame([("v1", "POSTING", "x.com"), ("v1", "POSTING", "x.com"), ("v2", "POSTING", "y.com")], "verification_id string, scope string, domain string").withColumn("scope_path", F.lit(""))
    entities = spark.createDataFrame([(1, "o", "POSTING"), (2, "o", "POSTING"), (3, "o", "CAMPAIGN")], "entity_id long, org_id string, kind string")
    orgs = spark.createDataFrame([("o", True, "x.com", "")], "org_id string, domain_verified boolean, official_domain string, scope_path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scoped = C.applicable_claims(claims, raw, checks, entities, orgs)
        got = sorted((r["claim_id"], r["applicable"]) for r in scoped.collect())
        plan = C.resolve_claims(scoped, counted=claims)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Evidence that is there twice gives a claim twice.
    want = [("a", False), ("a", True), ("b", False), ("c", True), ("c", True), ("d", False), ("e", True), ("f", False), ("f", False), ("g", False), ("g", False), ("h", False), ("h", False)]
    assert got == sorted([*want, *[("i", x) for x in (False, False, True, True)]])
    assert plan.count("Exchange hashpartitioning(entity_id") == 2 and "_hk" not in plan  # of claims, and of anchors


def test_postings_are_filtered_behind_an_exchange_of_lines(spark, tmp_path):
    from accordant.plans.q_serving import slim_view
    from accordant.plans.registry import Tables

    lines = spark.range(40).selectExpr(
        "id AS l_orderkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "id % 5 AS l_partkey", "id % 3 AS l_suppkey",
        "timestamp'1998-01-01' + make_dt_interval(cast(id AS int)) AS l_shipdate", "'R' AS l_returnflag", "'O' AS l_linestatus", "0.0D AS l_discount",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.range(5).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "'red' AS p_name", "10 AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    plan = slim_view(Tables(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_partkey" in plan and "Exchange hashpartitioning(entity_id" not in plan.split("Generate")[1]
