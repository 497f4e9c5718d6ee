"""Steps that several branches of a query read are worked out once and read from there; joins of rounds stay off the driver."""

from datetime import datetime

from pyspark.sql import functions as F

from accordant.operators import graph
from accordant.plans import load
from accordant.plans.registry import QUERIES
from accordant.session import fact_join

load()


def read_steps(df) -> set[str]:
    """The names of the stored tables and inputs that the rows come from."""
    folders = {f.split("/accordant-scratch/")[-1].split("/")[0] if "/accordant-scratch/" in f else "input" for f in df.inputFiles()}
    return {name.rsplit("-", 1)[0] for name in folders}


def write_parts(spark, folder):
    names = ["red ring", "red rings", "hot bolt", "hot bolt"]
    rows = [(i, names[i % 4], "Brand#1", "SMALL" if i % 3 else "LARGE", 1 + i % 2, 900.0 + 10 * i) for i in range(24)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(
        f"{folder}/part.parquet"
    )


def test_candidates_are_found_once_for_upsert_and_review(spark, tmp_path):
    write_parts(spark, tmp_path)
    upserted = QUERIES["d11_upsert_candidates"](spark, str(tmp_path))
    assert read_steps(upserted) == {"found-pairs"}
    reviewed = QUERIES["f10_review_candidates"](spark, str(tmp_path))
    assert read_steps(reviewed) == {"upserted-pairs"}
    before = {(r.left_id, r.right_id): r for r in upserted.collect()}
    after = {(r.left_id, r.right_id): r for r in reviewed.collect()}
    assert before and before.keys() == after.keys()
    for key, r in after.items():
        merged = key[1] % 4 == 0
        assert (r.score, r.reviewed) == (before[key].score, before[key].reviewed or merged)
        assert (r.decision, r.reason) == (("MERGE", "same post") if merged else (before[key].decision, None))


def test_fingerprints_are_taken_once_for_both_sides_of_a_check(spark, tmp_path):
    lines = [(k, k, k % 3, 1, "A", "O", datetime(1995 + k % 6, 3, 1)) for k in range(60)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(k, f"s{k}", k, 0.0) for k in range(3)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["d16_independence_conflicts"](spark, str(tmp_path))
    assert read_steps(found) == {"registered"}
    batches = {(k % 3, 1995 + k % 6) for k in range(60)}
    codes = {f"{s}-{y}": "same_file" if y < 1997 else "same_rows" if y < 1999 else "same_records" for s, y in batches if f"n{s}" < "n2"}
    assert {r.batch_id: r.code for r in found.collect()} == codes


def test_facts_are_extracted_once(spark, tmp_path):
    rows = [(i, f"the under line of words {i}\nand the lader of ment {i}", "en" if i % 2 else "de", "web", 1200) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    best = QUERIES["g10_representative_evidence"](spark, str(tmp_path))
    assert read_steps(best) == {"facts"}
    assert {r.entity_id for r in best.collect()} == set(range(6))
    profiles = QUERIES["g8_load_profiles"](spark, str(tmp_path))
    # Labels and preferences are read beside the facts.
    assert read_steps(profiles) == {"facts", "input"}
    assert {r.profile_id: r.has_evidence for r in profiles.collect()} == {i: i in (1, 3) for i in range(6)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_merges_broadcast_nothing(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    text = plan(graph._marked(graph._small_star(graph._large_star(edges))))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_fact_join_exchanges_both_sides_without_carrying_a_hash(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.max("id").alias("top"))
    joined = fact_join(rows, facts.hint("merge"), ["k"])
    text = plan(joined)
    assert text.count("hashpartitioning(k") >= 3 and "_hk" in text
    marker = rows.withColumn("n", F.lit(1)).select(F.pmod(F.xxhash64("k"), F.lit(1)).alias("m")).distinct().collect()
    assert [r.m for r in marker] == [0] and "pmod(xxhash64" in text
    assert joined.filter("top < id or top % 7 <> k or top < 993").count() == 0
