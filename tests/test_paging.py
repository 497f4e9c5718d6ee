"""Pages by seeking and by rank ranges, and nested cells, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from accordant.operators.paging import By, after, write_order
from accordant.sources.paged import CELL_KEYS, FALSE_TEXT, TRUE_TEXT, flatten_cell

SORT = (By("a", descending=True), By("b"), By("id"))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for k in range(500)]
    frame = spark.createDataFrame(rows, "id long, a int, b string").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0]))
    return frame, ordered


def test_all_pages_make_the_whole_order(table):
    frame, ordered = table
    order = write_order(frame, SORT, 9)
    assert order.total == 500
    for size in (1000, 64, 7):
        pages = -(-500 // size)
        numbers = range(1, pages + 2) if size > 10 else (1, 2, 40, pages, pages + 1)
        for k in numbers:
            got = [(r["rank"], r["id"], r["a"], r["b"]) for r in order.page(k, size).collect()]
            assert got == [(n + 1, *ordered[n]) for n in range((k - 1) * size, min(k * size, 500))]


def test_a_page_reads_its_ranges_only(table):
    order = write_order(table[0], SORT, 9)
    page = order.page(30, 10)
    files = page.select(F.input_file_name()).distinct().count()
    assert files <= 2
    assert "_range" in page._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]
    with pytest.raises(ValueError):
        order.page(0, 10)
    assert write_order(table[0].limit(0), SORT).page(1, 10).collect() == []


def test_seeking_through_the_order(table):
    frame, ordered = table
    for at in (0, 3, 77, 120, 350, 480, 499):
        last = ordered[at]
        got = [tuple(r) for r in after(frame, SORT, (last[1], last[2], last[0]), 25).select("id", "a", "b").collect()]
        assert got == ordered[at + 1 : at + 26]


def shown(cell):
    if cell is None:
        return ""
    if isinstance(cell, bool):
        return TRUE_TEXT if cell else FALSE_TEXT
    if isinstance(cell, list):
        return " / ".join(t for t in map(shown, cell) if t)
    if isinstance(cell, dict):
        for key in CELL_KEYS:
            if cell.get(key) not in (None, ""):
                return shown(cell[key])
        return json.dumps(cell, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return str(cell)


def test_cells_of_any_depth(spark):
    rng = random.Random(11)

    def cell(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice([None, True, False, "", 'te"xt\\ [x] {y}', "é", 12, -3])
        if kind == 4:
            return [cell(depth - 1) for _ in range(rng.randrange(4))]
        keys = rng.sample([*CELL_KEYS, "other", "more"], rng.randrange(1, 4))
        return {k: cell(depth - 1) for k in keys}

    cells = [cell(rng.randrange(9)) for _ in range(300)]
    deep = "deep"
    for k in range(40):
        deep = {"text": deep} if k % 2 else [None, deep]
    cells += [deep, {"text": {"text": {"text": {"text": {"text": "deep"}}}}}, {}, [], [[[]]], {"text": []}]
    rows = spark.createDataFrame([(k, json.dumps(c, ensure_ascii=False)) for k, c in enumerate(cells)], "k int, j string")
    got = {r["k"]: r["t"] for r in rows.select("k", flatten_cell(F.parse_json("j")).alias("t")).collect()}
    assert [got[k] for k in range(len(cells))] == [shown(c) for c in cells]
    assert spark.range(1).select(flatten_cell(F.parse_json(F.lit(None).cast("string")))).collect()[0][0] == ""


def test_a_cell_is_asked_for_its_members_once(spark):
    """An object gives all its members in one look, and what is a text already is passed on."""
    cells = ['[null,"a",[null,{"text":[1,{"name":""}]}],{"other":[{"url":"u"}]}]', '{"link":null,"url":"","name":{"email":[true,[]]}}', "null"]
    rows = spark.createDataFrame([(c,) for c in cells], "j string").select(flatten_cell(F.parse_json("j")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ['a / 1 / {"name":""} / {"other":[{"url":"u"}]}', "是", ""]
    assert rows._jdf.queryExecution().analyzed().toString().count("variant_get(") <= 12  # 28 when every key was looked up in the cell
