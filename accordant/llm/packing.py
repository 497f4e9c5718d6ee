"""Best-fit packing of documents into sequences, after a reduction by dominance.

Documents are encoded once and cut into pieces of at most `capacity` ids, written as Parquet with
each piece's place among the pieces of its length in its partition. The packing needs only how
many pieces there are of each length: at most `capacity` numbers, whatever the corpus. On the
driver these counts are packed (`plan`):

1. Reduction (after Martello and Toth). For the largest piece w, a set with w that dominates every
   other set with w can be fixed for good without losing an optimal packing: w alone if nothing
   fits beside it; w and the largest piece that fits, if this fills the sequence, or no two
   pieces fit beside w, or none of the fitting pairs is larger than it; w and the best pair, if it
   dominates all other pairs. Sets of more than three pieces are not looked at. The same set is
   fixed as often as its pieces last, then the shrunken instance is looked at again.
2. Best fit decreasing for what is left, on whole classes of sequences with equal content.

The plan says for each length which sequences take its first, second, ... piece. Pieces get their
number by prefix sums over the counts per partition and find their line of the plan by it.

Cases: a null or empty text is one piece with the end id (none if there is no end id); repeated
documents are packed each; a null id is kept; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import bisect
import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.tokens import encoder
from accordant.llm.words import small_batches
from accordant.session import scratch_path

CAPACITY = 1024


class Counts:
    """Pieces still unpacked, by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.of = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.of)

    def take(self, length: int, n: int) -> None:
        self.of[length] -= n
        if not self.of[length]:
            del self.of[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def largest(self, limit: int) -> int | None:
        """The largest length of at most `limit`."""
        k = bisect.bisect_right(self.lengths, limit)
        return self.lengths[k - 1] if k else None

    def smallest(self, n: int) -> list[int]:
        """The lengths of the n smallest pieces, or of all if there are fewer."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.of[length])
            if len(out) == n:
                break
        return out


def dominating_set(left: Counts, w: int, capacity: int) -> tuple[int, ...] | None:
    """The set with w that dominates every other set with w, if one of up to three pieces does.

    `left` is without w. A set dominates another if the other's pieces can be dealt out over its
    own, each group no longer than the piece it goes to.
    """
    room = capacity - w
    small = left.smallest(3)
    if not small or small[0] > room:
        return (w,)
    best = left.largest(room)
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return (w, best)
    if len(small) > 2 and sum(small) <= room:
        return None
    pairs = []  # of the fitting pairs: for each longer piece the longest partner
    for a in left.lengths:
        if a > room:
            break
        b = left.largest(min(a, room - a))
        if b == a and left.of[a] < 2:
            b = left.largest(a - 1)
        if b is not None and a + b <= room:
            pairs.append((a, b))
    if all(a + b <= best for a, b in pairs):
        return (w, best)
    first = next(((a, b) for a, b in pairs if a == best), None)
    if first and all(b <= first[1] or a + b <= best for a, b in pairs):
        return (w, *first)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets and how often each is fixed, what is left): fixed sets belong to some optimal packing."""
    left, fixed = Counts(counts), []
    moved = True
    while moved and left.lengths:
        moved = False
        for w in list(reversed(left.lengths)):
            while w in left.of:
                left.take(w, 1)
                found = dominating_set(left, w, capacity)
                if found is None:
                    left.of[w] = left.of.get(w, 0) + 1
                    if left.of[w] == 1:
                        bisect.insort(left.lengths, w)
                    break
                left.of[w] = left.of.get(w, 0) + 1
                if left.of[w] == 1:
                    bisect.insort(left.lengths, w)
                times = min(left.of[x] // found.count(x) for x in set(found))
                if len(found) > 1 and sum(found) < capacity:
                    times = max(1, times - 4)  # while four of each are left, the same set is found again
                for x in set(found):
                    left.take(x, times * found.count(x))
                fixed.append((found, times))
                moved = True
    return fixed, dict(left.of)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, for all sequences of equal content at once."""
    rooms: dict[int, list[list]] = {}  # free room -> [content, number of sequences]
    order: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([content, n])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            k = bisect.bisect_left(order, w)
            if k == len(order):
                each = capacity // w
                put(capacity - each * w, (w,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * w, (w,) * (n % each), 1)
                break
            room = order[k]
            content, have = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[k]
            each = room // w
            full = min(have, n // each)
            put(room - each * w, content + (w,) * each, full)
            n -= full * each
            if full < have:
                rest = min(n, each - 1) if n < each else 0
                put(room - rest * w, content + (w,) * rest, 1 if rest else 0)
                put(room, content, have - full - (1 if rest else 0))
                n -= rest
    return [(tuple(content), n) for held in rooms.values() for content, n in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences, as lengths, and how many sequences have each."""
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


@dataclasses.dataclass
class Lines:
    """For one length: pieces number[k] .. number[k + 1] - 1 go to sequences first[k], first[k] + 1, ...

    A sequence takes `each` of them, the first at `offset`.
    """

    number: list[int] = dataclasses.field(default_factory=lambda: [0])
    first: list[int] = dataclasses.field(default_factory=list)
    each: list[int] = dataclasses.field(default_factory=list)
    offset: list[int] = dataclasses.field(default_factory=list)

    def add(self, pieces: int, first: int, each: int, offset: int) -> None:
        self.number.append(self.number[-1] + pieces)
        self.first.append(first)
        self.each.append(each)
        self.offset.append(offset)


def assign(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, Lines]:
    """Where the pieces of each length go, by their number; sequences are numbered in plan order."""
    out: dict[int, Lines] = {}
    first = 0
    for content, times in packed:
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            out.setdefault(length, Lines()).add(times * each, first, each, offset)
            offset += each * length
        first += times
    return out


def encode_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int | None = None,
    drops_space: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, written once: doc_id, piece, start, length, ids, part, nth.

    ids are little-endian unsigned 32-bit integers. nth counts the pieces of one length in a part.
    """
    spark = small_batches(docs.sparkSession)
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, drops_space).encode
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                out: list[tuple] = []
                for doc, found in zip(rows.column(0).to_pylist(), encode(rows.column(1))):
                    ids = found.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    start, stop = 0, n % capacity or min(n, capacity)
                    piece = 0
                    while start < n:
                        out.append((doc, piece, start, stop - start, ids[4 * start : 4 * stop], int(seen[stop - start])))
                        seen[stop - start] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(columns[0], rows.schema.field(0).type),
                        "piece": pa.array(columns[1], pa.int32()),
                        "start": pa.array(columns[2], pa.int64()),
                        "length": pa.array(columns[3], pa.int64()),
                        "ids": pa.array(columns[4], pa.binary()),
                        "part": pa.array([part] * len(out), pa.int32()),
                        "nth": pa.array(columns[5], pa.int64()),
                    }
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    path = scratch_path(spark, "pieces")
    schema = f"doc_id {id_type}, piece int, start long, length long, ids binary, part int, nth long"
    docs.select(id_col, text_col).mapInArrow(cut, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def place_pieces(pieces: DataFrame, columns: list, capacity: int = CAPACITY) -> DataFrame:
    """`columns` of each piece with its sequence_id and offset.

    Only what is in `columns` travels; the ids stay where they were written.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(assign(plan(total, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = pieces.select(*columns, "length", "part", "nth")
    names = [c for c in rows.columns if c not in ("part", "nth")]
    numbered = rows.join(bases, ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("number"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy()
            numbers = batch.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                lines, own = shared.value[int(length)], lengths == length
                k = np.searchsorted(lines.number, numbers[own], "right") - 1
                nth = numbers[own] - np.array(lines.number)[k]
                each = np.array(lines.each)[k]
                sequence[own] = np.array(lines.first)[k] + nth // each
                offset[own] = np.array(lines.offset)[k] + nth % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[: len(names)])
    return numbered.mapInArrow(find, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, ids, length, sequence_id, offset."""
    return place_pieces(encode_pieces(docs, tokenizer, capacity=capacity, **options), ["doc_id", "piece", "start", "ids"], capacity)


def pack_report(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """As pack_documents, with the ids' CRC-32 in their place."""
    pieces = encode_pieces(docs, tokenizer, capacity=capacity, **options)
    return place_pieces(pieces, ["doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32")], capacity)
