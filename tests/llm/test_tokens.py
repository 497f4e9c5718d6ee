"""Encoder, token files and packing."""

import collections
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from accordant.llm import packing, queries, token_files
from accordant.llm.tokens import Encoder
from accordant.session import scratch_path
from tests.llm import plain

TOKENIZERS = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}
ENCODERS = {name: Encoder(queries.tokenizer(name), drops) for name, drops in TOKENIZERS.items()}
ALPHABET = [*"abcXYZ019 '.,!-_\n\t\r ", " ", "\xa0", "\x85", " ", "　", "é", "é", "Σ", "ς", "İ", "ſ", "漢", "😀", "\x1c", "\x00", "'s", "'ll", "<|endoftext|>", " \n"]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_units_give_the_ids_of_whole_texts(name):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(5000)] + ["", None]
    whole = plain.tokenizer(name)
    assert [x.tolist() for x in ENCODERS[name].encode(texts)] == [whole(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_units_give_the_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for name, encoder in ENCODERS.items():
        whole = plain.tokenizer(name)
        assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


def expected_files(rows, end):
    whole = plain.tokenizer("word_bpe_49k.json")
    start, out = 0, collections.Counter()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(text) + [end]
        out[doc, start, len(ids), plain.crc(ids)] += 1
        start += len(ids)
    return out


def test_token_files_round_trip(spark, docs, rows, none):
    path = queries.tokenizer("word_bpe_49k.json")
    folder = scratch_path(spark, "files")
    token_files.write_tokens(docs, folder, path, end_id=2, vocabulary=49_408)
    got = token_files.read_tokens(spark, folder)
    found = collections.Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect())
    assert found == expected_files(rows, 2)
    whole = plain.tokenizer("word_bpe_49k.json")
    texts = collections.defaultdict(set)
    for doc, text in rows:
        texts[doc].add((*whole(text), 2))
    assert all(tuple(r["ids"]) in texts[r["doc_id"]] for r in got.collect())
    empty = scratch_path(spark, "files")
    assert token_files.write_tokens(none, empty, path, end_id=2).count() == 0
    assert token_files.read_tokens(spark, empty).count() == 0


def test_wide_ids_need_wide_files(spark, docs, rows):
    folder = scratch_path(spark, "files")
    token_files.write_tokens(docs.select("doc_id", "text"), folder, queries.tokenizer("word_bpe_49k.json"), end_id=70_000, vocabulary=70_001)
    found = collections.Counter(tuple(r) for r in token_files.read_tokens(spark, folder, with_ids=False).collect())
    assert found == expected_files(rows, 70_000)


def test_op1(spark, sf, sf_rows):
    found = collections.Counter(tuple(r) for r in queries.QUERIES["op1_token_files"](spark, sf).collect())
    assert found == expected_files(sf_rows, 2)


def least(items, capacity):
    """The smallest number of sequences, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(r for r in rooms if r >= items[k]):
            rest = list(rooms)
            rest.remove(room)
            go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_an_optimal_packing(seed):
    rng = random.Random(seed)
    for _ in range(80):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce_counts(dict(collections.Counter(items)), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (least(rest, capacity) if rest else 0) == least(items, capacity)
        packed = packing.plan(dict(collections.Counter(items)), capacity)
        assert all(sum(c) <= capacity for c, _ in packed)
        assert collections.Counter(x for c, n in packed for x in c for _ in range(n)) == collections.Counter(items)


def test_plan_of_many_pieces_is_close_to_the_bound():
    rng = random.Random(3)
    counts = collections.Counter(min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(100_000))
    sequences = sum(n for _, n in packing.plan(dict(counts)))
    assert sequences <= 1.001 * sum(k * n for k, n in counts.items()) / 1024 + 1


def check_packing(pieces, rows, capacity):
    whole = plain.tokenizer("byte_bpe_50k.json")
    expected = collections.Counter()
    for doc, text in rows:
        ids = whole(text) + [2]
        stop, start, piece = len(ids) % capacity or min(len(ids), capacity), 0, 0
        while start < len(ids):
            expected[doc, piece, start, stop - start, plain.crc(ids[start:stop])] += 1
            start, stop, piece = stop, stop + capacity, piece + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in pieces)
    assert len(sequences) <= -(-total // capacity) + 3


def test_packing(spark, docs, rows, none):
    path = queries.tokenizer("byte_bpe_50k.json")
    check_packing(packing.pack_report(docs, path, capacity=256, end_id=2).collect(), rows, 256)
    assert packing.pack_report(none, path, end_id=2).count() == 0
    for r in packing.pack_documents(docs, path, capacity=256, end_id=2).collect():
        assert len(r["ids"]) == 4 * r["length"]


def test_op7(spark, sf, sf_rows):
    check_packing(queries.QUERIES["op7_packing"](spark, sf).collect(), sf_rows, 1024)
