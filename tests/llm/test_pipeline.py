"""The pipeline and its registration."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from accordant.llm import quality_rules, secret_scan
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.test_near_copies import kept_by_all_pairs
from tests.llm.test_tokens import check_packing


def test_all_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing",
    ]


def test_pipeline_against_a_plain_one(spark):
    """Stage after stage on sf0.01; what the learned rules reject is taken from their operator."""
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    report = {r["doc_id"]: r["kept"] for r in quality_rules.rule_report(documents, labels).collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert all(not report[i] for i, t in rows if plain.statistics(t)[-1])
    rows = sorted((i, t) for i, t in rows if report[i])
    stays = set(kept_by_all_pairs(rows)[0])
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if r[0] in stays]
    rows = [r for r, hit in zip(rows, plain.hits([t for _, t in rows], items)) if not hit[4]]
    assert len(rows) > 300
    clean = []
    for i, text in rows:
        out, at = "", 0
        for s, _, e in plain.base_spans(text):
            if s >= at:
                out += text[at:s] + secret_scan.MASK
            at = max(at, e)
        clean.append((i, out + text[at:]))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:4] == ["doc_id", "piece", "start", "ids"]
    check_packing(got.withColumn("ids_crc32", F.crc32("ids")).collect(), clean, 1024)


def test_stages_take_any_documents(spark, docs, sf):
    """Nulls, empty and long texts, repeated rows and further columns pass each stage, alone and in turn."""
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, frame, sf)
            assert kept.columns == docs.columns
            assert set(map(str, kept.select("doc_id", "text").dropna().collect())) <= set(map(str, frame.select("doc_id", "text").collect()))
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
        assert collections.Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == collections.Counter(r["doc_id"] for r in frame.collect())
