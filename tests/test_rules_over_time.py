"""Known files within one load, shortlist replay, overrides of stale decisions, suffix tables, headers."""

import datetime

import pytest
from pyspark.sql import functions as F

from accordant.functions import url
from accordant.operators import decisions as D, serving as S
from accordant.session import scratch_path
from accordant.sources import delimited
from accordant.sources.store import admit_batches


def at(day):
    return datetime.datetime(2024, 1, day)


def test_a_file_comes_twice_in_one_load(spark):
    rows = [
        ("b2", 1, "h", at(2), {"title": "a"}), ("b1", 1, "h", at(1), {"title": "a"}), ("b3", 1, "h", at(3), {"title": "z"}),
        ("b4", 2, "h", at(1), {"title": "a"}), ("b5", 3, "old", at(5), {"title": "a"}),
    ]
    schema = "batch_id string, source_id int, file_hash string, imported_at timestamp, mapping map<string,string>"
    batches = spark.createDataFrame(rows, schema)
    stored = spark.createDataFrame([("b0", 3, "old", at(1), {"title": "a"})], schema)
    got = sorted((r["batch_id"], r["source_id"], r["status"]) for r in admit_batches(batches, stored).collect())
    assert got == [("b0", 3, "already_imported"), ("b1", 1, "already_imported"), ("b1", 1, "imported"), ("b1", 1, "mapping_changed"), ("b4", 2, "imported")]
    assert admit_batches(batches, None).filter("status = 'imported'").count() == 3


SHORTLIST = "entity_id int, priority int, note string, stage string, next_action string, next_action_at timestamp, applied_at timestamp, added_at timestamp"


def replay(spark, commands, held=()):
    shortlist = spark.createDataFrame(list(held), SHORTLIST)
    schema = "entity_id int, action string, priority int, note string, stage string, next_action string, next_action_at timestamp, at timestamp"
    moves = spark.createDataFrame([(e, a, 5, "n", s, f"do {d}", None, at(d)) for e, a, s, d in commands], schema)
    ready = spark.createDataFrame([(e, True) for e in range(9)] + [(9, False)], "entity_id int, is_ready boolean")
    out, _, rejected = S.update_shortlist(shortlist, moves, ready)
    listed = {r["entity_id"]: (r["stage"], r["next_action"], r["applied_at"], r["added_at"]) for r in out.collect()}
    return listed, sorted((r["entity_id"], r["action"], r["error"]) for r in rejected.collect())


def test_an_entry_added_again_begins_anew(spark):
    commands = [
        (1, "ADD", None, 1), (1, "STAGE", "APPLIED", 2), (1, "REMOVE", None, 3), (1, "ADD", None, 4),
        (2, "ADD", None, 1), (2, "STAGE", "APPLIED", 2), (2, "STAGE", "OFFER", 3),
        (3, "STAGE", "APPLIED", 1), (3, "ADD", None, 2), (3, "ADD", None, 5), (4, "ADD", None, 1), (4, "REMOVE", None, 2), (4, "STAGE", "OFFER", 3),
        (5, "STAGE", "OFFER", 2), (6, "REMOVE", None, 1), (6, "ADD", None, 2), (9, "ADD", None, 1), (11, "ADD", None, 1),
    ]
    held = [(e, 1, "o", "APPLIED", "old", None, at(1), at(1)) for e in (5, 6, 7)]
    listed, rejected = replay(spark, commands, held)
    assert listed == {
        1: ("TO_APPLY", "", None, at(4)), 2: ("OFFER", "do 3", at(2), at(1)), 3: ("TO_APPLY", "", None, at(2)),
        5: ("OFFER", "do 2", at(1), at(1)), 6: ("TO_APPLY", "", None, at(2)), 7: ("APPLIED", "old", at(1), at(1)),
    }
    assert rejected == [(3, "STAGE", "not_listed"), (4, "STAGE", "not_listed"), (9, "ADD", "not_ready"), (11, "ADD", "not_found")]


HISTORY = "decision_id string, entity_id int, profile_id string, trust string, fingerprint string, manual string, override_reason string, created_at timestamp, is_current boolean"


def test_overrides_of_one_moment_leave_one_current_line(spark):
    history = spark.createDataFrame(
        [("d1", 1, "p", "OK", "f", "UNDECIDED", "", at(1), True), ("d2", 1, "q", "OK", "f", "UNDECIDED", "", at(1), True)], HISTORY
    )
    commands = spark.createDataFrame([(1, "p", m, m.lower(), at(2)) for m in ("HOLD", "REJECT", "REJECT")], "entity_id int, profile_id string, manual string, reason string, at timestamp")
    out, rejected = D.override_decisions(history, commands)
    current = out.filter("is_current").collect()
    assert sorted((r["profile_id"], r["manual"]) for r in current) == [("p", "REJECT"), ("q", "UNDECIDED")]
    assert out.select("decision_id").distinct().count() == out.count() == 4
    assert rejected.count() == 0


def test_an_override_does_not_attach_to_a_stale_line(spark):
    history = spark.createDataFrame(
        [(f"d{e}", e, "p", "OK", "f", "UNDECIDED", "", at(1), True) for e in (1, 2, 3)], HISTORY
    )
    fresh = spark.createDataFrame([(1, "p", "OK", "f", at(3)), (2, "p", "BAD", "g", at(3)), (3, "p", "BAD", "g", at(3))], "entity_id int, profile_id string, trust string, fingerprint string, created_at timestamp")
    commands = spark.createDataFrame([(e, "p", "HOLD", "why", at(4)) for e in (1, 2)], "entity_id int, profile_id string, manual string, reason string, at timestamp")
    out, _ = D.override_decisions(history, commands, fresh)
    lines = {(r["entity_id"], r["trust"], r["manual"]) for r in out.filter("is_current").collect()}
    assert lines == {(1, "OK", "HOLD"), (2, "BAD", "HOLD"), (3, "OK", "UNDECIDED")}


def test_suffixes_from_a_table(spark):
    suffixes = spark.createDataFrame([(s,) for s in ("de", "uk", "co.uk", "jp", "co.jp", "*.ck", "!www.ck", "com")], "suffix string")
    hosts = {
        "jobs.bosch.de": True, "careers.bbc.co.uk": True, "bbc.co.uk": True, "co.uk": False, "uk": False, "x.co.jp": True, "a.unlisted": True,
        "unlisted": False, "x.ck": False, "y.x.ck": True, "www.ck": True, "ck": False, None: None,
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    marked = url.mark_registrable(rows, F.col("host"), suffixes, "ok")
    assert {r["host"]: r["ok"] for r in marked.collect()} == hosts
    scoped = url.mark_registrable(rows, url.scope_host(F.col("host")), suffixes, "ok").select("host", url.official_scope(F.col("host"), registrable=F.col("ok")).alias("s"))
    got = {r["host"]: r["s"] for r in scoped.filter("host IS NOT NULL").collect()}
    assert got["jobs.bosch.de"]["domain"] == "jobs.bosch.de" and got["careers.bbc.co.uk"]["error"] is None
    assert got["co.uk"]["error"] == "public_suffix"


def test_files_with_another_header_are_refused(spark):
    path = scratch_path(spark, "headers")
    for header, folder in ((("company", "title"), "a"), (("title", "company"), "b")):
        spark.createDataFrame([("x", "y")], list(header)).coalesce(1).write.option("header", "true").csv(f"{path}/{folder}")
    rows, _ = delimited.read_delimited(spark, f"{path}/a", sep=",")
    assert rows.count() == 1
    with pytest.raises(Exception, match="(?i)header|enforceSchema"):
        rows, _ = delimited.read_delimited(spark, f"{path}/*", sep=",")
        rows.collect()
