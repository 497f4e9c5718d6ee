"""From supplier files to resolved entities, with the counts the demo sources must give."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from accordant.operators import curation, imports, ingest, snapshots
from accordant.sources import delimited, embedded, paged, sinks, store, texts

ALPHA = """记录ID,公司名称,招聘岗位,工作城市,毕业年份,学历要求,招聘批次,截止日期,公告链接,投递链接,备注
A-1,云智,"AI产品经理、数据科学家、大模型应用工程师","上海、杭州、深圳",2027届,"本科、硕士",秋招,招满为止,https://c.one.example/campus,https://c.one.example/campus,线索
A-2,星算,平台产品经理（校招）,上海,2027届,硕士,秋招,2026-09-30,https://c.one.example/jobs/PM1001,https://c.one.example/jobs/PM1001,具体
A-3,灵境,AI 产品经理（方向）,杭州,2027届,硕士,秋招,2026-09-30,https://c.one.example/jobs/PM1002,https://c.one.example/jobs/PM1002,具体
A-4,识图,AI 数据分析实习生（产品方向）,上海,2027届,"本科、硕士",秋招,招满为止,https://j.two.example/position/DP2027,https://j.two.example/position/DP2027,待核验
A-5,珞川,"解决方案工程师、控制算法工程师、嵌入式工程师","上海、苏州",2027届,硕士,提前批,2026-08-31,https://j.three.example/campus,https://j.three.example/campus,多岗位
"""
BETA = "\n".join(
    "\t".join(cells)
    for cells in [
        ["record_id", "employer", "role", "location", "graduate_year", "degree", "batch", "deadline", "source_url", "application_url", "notes"],
        ["B-1", "星算科技有限公司", "平台产品经理（校招）", "上海", "2027届", "硕士", "秋招", "2026-10-10", "https://c.one.example/jobs/PM1001?utm_source=b", "https://c.one.example/jobs/PM1001", "冲突"],
        ["B-2", "识图科技有限公司", "AI 数据分析实习生（产品方向）", "上海/杭州", "2026届、2027届", "硕士", "秋招", "尽快投递", "https://j.two.example/position/DP2027", "https://j.two.example/position/DP2027", "确认"],
        ["B-3", "碳硅", "AI 解决方案设计实习生", "上海", "2027届", "硕士", "秋招", "招满为止", "https://j.a.example/job/1001", "https://j.a.example/job/1001", "待"],
        ["B-4", "云构", "工业软件技术产品经理", "上海", "2027届", "硕士", "秋招", "招满为止", "https://j.b.example/job/1009", "https://j.b.example/job/1009", "待"],
    ]
)


def load(spark, folder: Path, name: str, text: str):
    path = folder / name
    path.write_text("﻿" + text, encoding="utf-8")
    rows, quarantine = delimited.read_delimited(spark, str(path))
    header = [c for c in rows.columns if c not in ("file", "row_number")]
    mapping = ingest.resolve_mapping(header)
    parsed = ingest.parse_rows(ingest.pack_raw(rows, header), mapping)
    return parsed.withColumn("batch_id", F.lit(name)), quarantine


def batch_of(spark, name: str, source: str, day: str):
    return spark.createDataFrame(
        [(name, source, name, "csv", None, f"{day} 00:00:00")],
        "batch_id string, source_id string, file_name string, file_format string, snapshot_at string, imported_at string",
    ).withColumns({"snapshot_at": F.col("snapshot_at").cast("timestamp"), "imported_at": F.col("imported_at").cast("timestamp")})


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(
        [("a", "来源甲", "PAID_TABLE", "g1"), ("b", "来源乙", "PAID_TABLE", "g2")],
        "source_id string, name string, kind string, independence_group string",
    )


@pytest.fixture(scope="module")
def flow(spark, sources, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flow")
    alpha, _ = load(spark, folder, "alpha.csv", ALPHA)
    beta, _ = load(spark, folder, "beta.tsv", BETA)
    state = imports.empty_state(spark)
    state, first = imports.materialize(state, alpha, batch_of(spark, "alpha.csv", "a", "2026-08-01"), sources)
    first = first.groupBy("outcome").count().collect()
    state, second = imports.materialize(state, beta, batch_of(spark, "beta.tsv", "b", "2026-08-02"), sources)
    return state, dict(map(tuple, first)), dict(map(tuple, second.groupBy("outcome").count().collect())), alpha


def test_two_sources(flow):
    state, first, second, _ = flow
    assert first == {"created": 5}
    assert second == {"created": 2, "reused": 2}
    assert state["entities"].count() == 7
    assert state["origins"].count() == 9
    assert state["entities"].filter("kind = 'CAMPAIGN'").count() == 2


def test_conflicting_deadline_is_not_selected(flow):
    state = flow[0]
    entity = state["entities"].filter("official_job_id = 'PM1001'").collect()
    assert len(entity) == 1
    claims = state["claims"].filter((F.col("entity_id") == entity[0]["entity_id"]) & (F.col("field") == "deadline"))
    rows = claims.collect()
    assert len(rows) == 2 and all(r["reason"] == "conflict" and not r["selected"] for r in rows)
    titles = state["claims"].filter((F.col("entity_id") == entity[0]["entity_id"]) & (F.col("field") == "title"))
    assert sorted(r["reason"] for r in titles.collect()) == ["agrees", "selected"]


def test_same_rows_again_change_nothing(spark, sources, flow):
    state, _, _, alpha = flow
    again, outcome = imports.materialize(state, alpha, batch_of(spark, "alpha.csv", "a", "2026-08-01"), sources)
    assert outcome.count() == 0
    assert again["origins"].count() == 9 and again["claims"].count() == state["claims"].count()


def test_identity_ladder(flow):
    strengths = {r["identity"]["strength"] for r in flow[3].select("identity").collect()}
    assert strengths == {"SOURCE_RECORD_ID"}


def test_surplus_cells_are_quarantined(spark, tmp_path):
    rows, quarantine = load(spark, tmp_path, "x.csv", "公司,岗位\na,b\nc\nd,e,f\n\"g, h\",\"i\nj\"\n")
    assert quarantine.count() == 1
    got = {(r["rec"]["company"], r["rec"]["title"], r["parse_status"]) for r in rows.collect()}
    assert got == {("a", "b", "PARSED"), ("c", "", "PARTIAL"), ("g, h", "i j", "PARSED")}


def test_missing_columns_are_fatal():
    with pytest.raises(ingest.MappingError):
        ingest.resolve_mapping(["公司", "城市"])
    assert ingest.check_mapping({"company": "a", "title": "b", "source_record_id": "行号"}) == ["positional_record_id"]


def test_embedded_table(spark, tmp_path):
    good = "# t\n快照时间：2026-08-01T10:00:00\n全量记录数：3\n序号\t公司名称\t岗位名称\n<!-- DATA_START -->\n1\ta\tb\n2\tc\n3\td\te\n~~~\n4\tx\ty\n"
    (tmp_path / "good.md").write_text(good, encoding="utf-8")
    (tmp_path / "bad.md").write_text(good.replace("：3", "：4"), encoding="utf-8")
    rows, quarantine, meta = embedded.read_embedded_table(spark, str(tmp_path / "good.md"))
    assert {r["raw"]["公司名称"] for r in rows.collect()} == {"a", "d"}
    assert [r["line_number"] for r in quarantine.collect()] == [7]
    embedded.require_complete(meta)
    assert str(meta.collect()[0]["snapshot_at"]) == "2026-08-01 10:00:00"
    with pytest.raises(ValueError, match="count_mismatch"):
        embedded.require_complete(embedded.read_embedded_table(spark, str(tmp_path / "bad.md"))[2])


def test_paged_load(spark, tmp_path):
    (tmp_path / "page-1.json").write_text(
        '{"code":0,"data":{"items":[{"record_id":"r2","fields":{"岗位":[{"text":"甲"},{"text":"乙"}],"开":true,"链":{"link":"u","text":"t"},"空":null,"数":1.5,"物":{"b":1,"a":2}}}],"has_more":true,"page_token":"p"}}'
    )
    (tmp_path / "page-2.json").write_text('{"code":0,"data":{"items":[{"record_id":"r1","fields":{"岗位":"丙"}}],"has_more":false}}')
    pages = paged.read_pages(spark, str(tmp_path))
    records = paged.page_records(pages)
    assert paged.check_paged_load(pages, records, 5).count() == 0
    rows, header = paged.read_paged_json(spark, str(tmp_path))
    assert header[0] == "记录ID" and set(header) == {"记录ID", "岗位", "开", "链", "空", "数", "物"}
    got = {r["record_id"]: r["raw"] for r in rows.collect()}
    assert got["r2"]["岗位"] == "甲 / 乙" and got["r2"]["开"] == "是" and got["r2"]["链"] == "u"
    assert got["r2"]["空"] == "" and got["r2"]["数"] == "1.5" and got["r2"]["物"] == '{"a":2,"b":1}'
    cut = pages.filter("page_no = 1")
    assert [r["code"] for r in paged.check_paged_load(cut, paged.page_records(cut), 5).collect()] == ["last_page_missing"]
    none = pages.filter("page_no > 2")
    assert "empty_after_rows" in {r["code"] for r in paged.check_paged_load(none, paged.page_records(none), 5).collect()}


def test_text_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿硕士研究生简历".encode())
    (tmp_path / "b.txt").write_bytes("硕士研究生简历".encode("gb18030"))
    assert {r["text"] for r in texts.read_text_docs(spark, str(tmp_path)).collect()} == {"硕士研究生简历"}


def test_batch_store(spark, tmp_path, flow):
    root = str(tmp_path / "store")
    rows = flow[3].select("row_number", "row_hash", "batch_id").withColumn("source_id", F.lit("a"))
    batch = batch_of(spark, "alpha.csv", "a", "2026-08-01").withColumns(
        {"file_hash": F.lit("h"), "mapping": F.create_map(F.lit("title"), F.lit("招聘岗位"))}
    )
    assert [r["status"] for r in store.write_batch(rows, batch, root).collect()] == ["imported"]
    again = batch.withColumn("batch_id", F.lit("other"))
    verdict = store.write_batch(rows.withColumn("batch_id", F.lit("other")), again, root).collect()
    assert [(r["status"], r["batch_id"]) for r in verdict] == [("already_imported", "alpha.csv")]
    assert spark.read.parquet(f"{root}/raw").count() == 5
    with pytest.raises(ValueError, match="mapping_changed"):
        store.write_batch(rows, batch.withColumn("mapping", F.create_map(F.lit("title"), F.lit("x"))), root)


def test_sync_counts(spark):
    def snap(*rows):
        return spark.createDataFrame(rows, "id string, h string")

    first = snapshots.snapshot_diff(None, snap(("r1", "a"), ("r2", "b")), "id", "h")
    second = snapshots.snapshot_diff(snap(("r1", "a"), ("r2", "b")), snap(("r2", "c"), ("r3", "d")), "id", "h")
    assert first.groupBy("change").count().collect()[0][1] == 2
    assert {r["id"]: r["change"] for r in second.collect()} == {"r1": "MISSING", "r2": "MODIFIED", "r3": "ADDED"}
    with pytest.raises(ValueError):
        snapshots.snapshot_diff(None, snap(("r1", "a"), ("r1", "b")), "id", "h")


def test_exports(spark, tmp_path):
    row = spark.createDataFrame(
        [(True, "=c", "t", ["a", "b"], "PASS", "APPLY", "VERIFIED", "OPEN", "u", "TO_APPLY", "@n", None, 3, "备注", "e1", None)],
        "ready boolean, company string, title string, cities array<string>, eligibility string, evidence_fit string, trust string, verification string, apply_url string, application_stage string, next_action string, next_action_at timestamp, priority int, note string, entity_id string, added_at timestamp",
    )
    rows = sinks.export_rows(row)
    sinks.export_csv(rows, str(tmp_path / "csv"))
    files = [p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("*.csv")]
    assert all(text.startswith("\ufeffcompany,title,cities") for text in files)
    assert "\n'=c,t,a / b,PASS,APPLY,VERIFIED,OPEN,u,TO_APPLY,'@n,,3,备注\n" in "".join(files)
    sinks.export_markdown(rows, str(tmp_path / "md"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part*")))
    assert page.startswith("# 可信投递短名单\n\n## 1. =c｜t\n\n- 城市：a / b")
    sinks.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_merge_keeps_evidence(spark, flow):
    state = flow[0]
    pair = state["entities"].filter("official_job_id in ('1001', '1009')").select("entity_id").collect()
    left, right = sorted(r["entity_id"] for r in pair)
    commands = spark.createDataFrame([(left, right)], "left_id string, right_id string")
    _, refused = curation.apply_merges(state, commands)
    assert {r["error"] for r in refused.collect()} == {"different_ids"}
    org = state["entities"].filter(F.col("entity_id") == left).collect()[0]["org_id"]
    same = state["entities"].withColumns(
        {
            "official_job_id": F.when(F.col("entity_id") != right, F.col("official_job_id")),
            "org_id": F.when(F.col("entity_id") == right, F.lit(org)).otherwise(F.col("org_id")),
        }
    )
    merged, refused = curation.apply_merges({**state, "entities": same}, commands)
    assert refused.count() == 0
    assert merged["origins"].count() == 9
    assert merged["origins"].filter(F.col("entity_id") == left).count() == 2
    shells = merged["entities"].filter("review_status = 'MERGED'").collect()
    assert [r["entity_id"] for r in shells] == [right]
    assert merged["claims"].filter(F.col("entity_id") == right).count() == 0
    # Both rows come from one source, so the later one supersedes the earlier.
    reasons = merged["claims"].filter((F.col("entity_id") == left) & (F.col("field") == "title")).select("reason")
    assert sorted(r["reason"] for r in reasons.collect()) == ["selected", "superseded"]


def test_sync_of_landed_batches(spark, tmp_path):
    from accordant.streaming.landing import sync_landed

    schema = "batch_id string, source_id string, row_hash string, landed_at timestamp"
    landed, root = str(tmp_path / "landed"), str(tmp_path / "root")

    def land(batch, hashes):
        rows = spark.createDataFrame([(batch, "s", h) for h in hashes], "batch_id string, source_id string, row_hash string")
        rows.withColumn("landed_at", F.lit("2026-08-01").cast("timestamp")).write.mode("append").parquet(landed)

    def run():
        sync_landed(spark, landed, schema, root, str(tmp_path / "progress"), {"title": "岗位"})
        return spark.read.parquet(f"{root}/raw").count()

    land("b1", ["x", "y"])
    assert run() == 2
    land("b2", ["y", "x"])
    land("b3", ["z"])
    assert run() == 3
    assert run() == 3
