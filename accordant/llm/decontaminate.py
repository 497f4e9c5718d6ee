"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every text.

The n-grams of the test items go to the tasks as a sorted array of hashes with their words. Each
text is read once, every run of n words is looked up, hits are verified word by word, and the
hit words or the whole document can be removed. There is no shuffle.

The broadcast never holds more than `max_windows` n-grams: a longer item list is taken in blocks,
each of which passes over the documents, with a checkpoint between.

Cases: a null or empty text, or one without a word, has no hit; an item without words matches
nothing; an item of fewer than n words is one n-gram; equal items are all reported; repeated
documents are each judged; a null item_id is left out of the listed items. Other columns pass
through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from accordant.llm.words import ALNUM, LOWER, Words, blocks, small_batches
from accordant.session import checkpoint

NGRAM = 10
MAX_WINDOWS = 1_000_000
STATE = "__llm_hits"
SLOTS = 1 << 20


class TestSet:
    """N-grams of some test items: hash -> {words: item ids}, and a bit table in front."""

    __test__ = False  # not a test class

    def __init__(self):
        self.by_length: dict[int, dict[int, dict[bytes, list]]] = {}
        self.size = 0

    def add(self, item_id, text: str | None, ngram: int) -> None:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(LOWER[raw], np.array([0, len(raw)]), ALNUM)
        n = len(words.start)
        if not n:
            return
        length = min(n, ngram)
        at = np.arange(n - length + 1)
        known = self.by_length.setdefault(length, {})
        for place, h in zip(at.tolist(), words.run_hashes(at, length).tolist()):
            ids = known.setdefault(h, {}).setdefault(words.bytes_of(place, length), [])
            if item_id not in ids[-1:]:
                ids.append(item_id)
                self.size += 1

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for length, known in self.by_length.items():
            hashes = np.array(sorted(known), np.uint64)
            bits = np.zeros(SLOTS, bool)
            bits[hashes & np.uint64(SLOTS - 1)] = True
            out[length] = hashes, bits
        return out


def test_sets(benchmark: DataFrame, ngram: int, max_windows: int, id_col: str, text_col: str) -> Iterator[TestSet]:
    found = TestSet()
    for row in benchmark.select(id_col, text_col).toLocalIterator(prefetchPartitions=True):
        found.add(row[0], row[1], ngram)
        if found.size >= max_windows:
            yield found
            found = TestSet()
    if found.size:
        yield found


def scan(known: TestSet, tables: dict, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
    """For each text: which of its words are hit, and the ids of the items found."""
    words = Words(LOWER[data], offsets, ALNUM)
    change = np.zeros(len(words.start) + 1, np.int64)
    items: dict[int, set] = {}
    for length, (hashes, bits) in tables.items():
        at = words.windows(length)
        h = words.run_hashes(at, length)
        maybe = bits[h & np.uint64(SLOTS - 1)]
        at, h = at[maybe], h[maybe]
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        same = hashes[place] == h
        for start, value in zip(at[same].tolist(), h[same].tolist()):
            ids = known.by_length[length][value].get(words.bytes_of(start, length))
            if ids is not None:
                change[start] += 1
                change[start + length] -= 1
                items.setdefault(int(words.text_of[start]), set()).update(ids)
    hit = np.cumsum(change[:-1]) > 0
    for d in range(len(offsets) - 1):
        yield hit[words.first[d] : words.first[d + 1]], sorted(x for x in items.get(d, ()) if x is not None)


Finish = Callable[[list[pa.Array], list[dict]], pa.RecordBatch]


def scan_all(
    docs: DataFrame, benchmark: DataFrame, finish: Finish, schema: T.StructType, *,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """What `finish` makes of each batch's columns and of a dict for each text: hit (by word), items (ids).

    The last block of test items is looked up and finished in one pass; before it, a column STATE
    carries what was found from block to block.
    """
    spark = small_batches(docs.sparkSession)
    base = docs.drop(STATE)
    item_type = benchmark.schema[item_col].dataType
    state = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit", T.BinaryType()),
            T.StructField("items", T.ArrayType(item_type)),
        ]
    )
    arrow_state = pa.struct([("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(to_arrow_type(item_type)))])
    at, names = base.columns.index(text_col), [*base.columns, STATE]
    done = base
    sets = test_sets(benchmark, ngram, max_windows, item_col, item_text_col)
    found = next(sets, TestSet())
    number = 0
    while found is not None:
        following = next(sets, None)
        shared = spark.sparkContext.broadcast((found, found.tables()))

        def run(batches, shared=shared, again=number > 0, last=following is None):
            known, tables = shared.value
            for batch in batches:
                old = batch.column(batch.num_columns - 1).to_pylist() if again else None
                columns = batch.columns[: len(names) - 1]
                out = []
                for rows, data, offsets in blocks(batch.column(at)):
                    for row, (hit, items) in enumerate(scan(known, tables, data, offsets), rows.start):
                        if old:
                            hit = hit | np.unpackbits(np.frombuffer(old[row]["hit"], np.uint8), count=len(hit)).astype(bool)
                            items = sorted({*items, *old[row]["items"]})
                        out.append({"hit": hit, "items": items})
                if last:
                    yield finish(columns, out)
                else:
                    packed = [{"n_words": len(x["hit"]), "hit": np.packbits(x["hit"]).tobytes(), "items": x["items"]} for x in out]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, arrow_state)], names=names)

        if number:
            done = checkpoint(done)
        done = done.mapInArrow(run, schema if following is None else T.StructType([*base.schema.fields, T.StructField(STATE, state)]))
        found, number = following, number + 1
    return done


def hit_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""

    def digest(columns: list[pa.Array], found: list[dict]) -> pa.RecordBatch:
        hits = [int(x["hit"].sum()) for x in found]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": columns[0],
                "n_words": pa.array([len(x["hit"]) for x in found], pa.int64()),
                "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(x["items"]) for x in found], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(sorted(map(str, x["items"]))).encode()).hexdigest() for x in found], pa.string()),
                "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
            }
        )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )
    return scan_all(docs.select(id_col, text_col), benchmark, digest, schema, text_col=text_col, **options)


def remove_hits(docs: DataFrame, benchmark: DataFrame, *, whole_documents: bool = True, text_col: str = "text", **options) -> DataFrame:
    """`docs` without contaminated documents or, with whole_documents=False, without the hit words.

    Cutting words keeps everything else of the text, white space around them included.
    """
    base = docs.drop(STATE)
    at, names = base.columns.index(text_col), base.columns

    def cut(columns: list[pa.Array], found: list[dict]) -> pa.RecordBatch:
        if whole_documents:
            batch = pa.RecordBatch.from_arrays(columns, names=names)
            return batch.filter(pa.array([not x["hit"].any() for x in found], pa.bool_()))
        texts = columns[at].to_pylist()
        for row, x in enumerate(found):
            if x["hit"].any():
                raw = np.frombuffer(texts[row].encode(), np.uint8)
                words = Words(LOWER[raw], np.array([0, len(raw)]), ALNUM)
                change = np.zeros(len(raw) + 1, np.int64)
                change[words.start[x["hit"]]] += 1
                change[words.end[x["hit"]]] -= 1
                texts[row] = raw[np.cumsum(change[:-1]) == 0].tobytes().decode()
        return pa.RecordBatch.from_arrays([*columns[:at], pa.array(texts, columns[at].type), *columns[at + 1 :]], names=names)

    return scan_all(base, benchmark, cut, base.schema, text_col=text_col, **options)
