"""The batch store: two loads at once, and readers that see whole loads only."""

import pytest
from pyspark.sql import functions as F

from accordant.sources import store


def load_of(spark, *files):
    """rows and batches of files given as (batch_id, file_hash, number of rows)."""
    rows = spark.createDataFrame([(b, "s", n) for b, _, count in files for n in range(count)], "batch_id string, source_id string, row_number int")
    batches = spark.createDataFrame([(b, "s", h) for b, h, _ in files], "batch_id string, source_id string, file_hash string")
    return rows, batches.withColumns({"imported_at": F.lit("2026-01-01").cast("timestamp"), "mapping": F.create_map(F.lit("a"), F.lit("b"))})


def statuses(verdict):
    return sorted((r["batch_id"], r["status"]) for r in verdict.collect())


def stored_rows(spark, root):
    rows = store.read_committed(spark, root, store.RAW)
    return sorted((r["batch_id"], r["row_number"]) for r in rows.collect()) if rows is not None else []


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "store")


def test_of_two_loads_at_once_one_admits_a_file(spark, root, monkeypatch):
    first, second = load_of(spark, ("b1", "h1", 3), ("b2", "h2", 2)), load_of(spark, ("c1", "h1", 3), ("c3", "h3", 1))
    commit, overtaken = store.commit_load, []

    def late(session, where, number, load):
        monkeypatch.setattr(store, "commit_load", commit)
        overtaken.extend(statuses(store.write_batch(*second, root)))
        return commit(session, where, number, load)

    monkeypatch.setattr(store, "commit_load", late)
    verdict = store.write_batch(*first, root)
    # The other load came in between, so its file h1 is known by the time the first one commits.
    assert overtaken == [("c1", "imported"), ("c3", "imported")]
    assert statuses(verdict) == [("b2", "imported"), ("c1", "already_imported")]
    assert stored_rows(spark, root) == [("b2", 0), ("b2", 1), ("c1", 0), ("c1", 1), ("c1", 2), ("c3", 0)]
    assert spark.read.parquet(f"{root}/raw").count() == 6
    batches = store.read_committed(spark, root, store.BATCHES)
    assert batches.groupBy("source_id", "file_hash").count().filter("count > 1").count() == 0 and batches.count() == 3
    assert len(store.committed_loads(spark, root)) == 2


def test_an_uncommitted_load_is_not_seen(spark, root, monkeypatch):
    store.write_batch(*load_of(spark, ("b1", "h1", 2)), root)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError):
        patched.setattr(store, "commit_load", lost)
        store.write_batch(*load_of(spark, ("b2", "h2", 4)), root)
    assert stored_rows(spark, root) == [("b1", 0), ("b1", 1)]
    assert statuses(store.write_batch(*load_of(spark, ("b2", "h2", 4)), root)) == [("b2", "imported")]
    assert len(stored_rows(spark, root)) == 6


def test_numbers_are_given_once(spark, root):
    assert store.committed_loads(spark, root) == [] and store.read_committed(spark, root, store.RAW) is None
    assert store.commit_load(spark, root, 1, "x") and not store.commit_load(spark, root, 1, "y")
    assert store.commit_load(spark, root, 2, "z")
    assert store.committed_loads(spark, root) == ["x", "z"]


def test_a_load_of_known_files_commits_nothing(spark, root):
    load = load_of(spark, ("b1", "h1", 2))
    store.write_batch(*load, root)
    assert statuses(store.write_batch(*load, root)) == [("b1", "already_imported")]
    assert len(store.committed_loads(spark, root)) == 1
