"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A block of texts is one flat byte array with offsets. Words are runs of word bytes inside one
text; every word, and every run of k words, gets a 64-bit hash from prefix sums modulo 2^64.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import shared_folder

BLOCK_BYTES = 1 << 20  # texts are worked on in blocks of about so many bytes; one longer text is its own block
ROWS_PER_BATCH = 2000

# Multipliers are 5 modulo 8, so that powers differ in all but the lowest bits.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD95

#: Bytes of words between ASCII white space: everything but 20 and 09 to 0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of normalised words: digits, letters a to z, and all of any other script.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_CASE = {c: c + 32 for c in range(0x41, 0x5B)}


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows of one Arrow batch, so that Python holds a bounded part of a partition.

    Workers also get the place of this package, for sessions that began without it on their path.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    shared_folder(spark)
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, home])
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): a row key made of values, so that it survives recomputation.

    Rows with the same id and text share a key; whatever is found for one holds for the other.
    """
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        doc.alias("id"),
        text.alias("text"),
        F.xxhash64(doc, text).alias("k1"),
        F.coalesce(doc, F.lit(-1)).alias("k2"),
    )


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest list asked for is kept for each base."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(12, (n - 1).bit_length()), base & (2**64 - 1), np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n] if n else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end; equal bytes have equal hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BYTE_BASE, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_inverse(BYTE_BASE), len(data) + 1)[start])


class Words:
    """The words of a block of texts.

    start, end: byte places of the words; first[d] to first[d + 1]: the words of text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE):
        self.data, self.offsets = data, offsets
        inside = word_bytes[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(data):
            edges = offsets[:-1][offsets[:-1] < len(data)]
            before[edges] = False
            ends = offsets[1:][offsets[1:] > offsets[0]]
            after[ends - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @functools.cached_property
    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        sums = np.zeros(len(self.start) + 1, np.uint64)
        np.cumsum(self.hashes * powers(WORD_BASE, len(self.start)), out=sums[1:])
        return sums

    def run_hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """A hash of the `length` words from each place `at`; equal runs have equal hashes."""
        shift = powers(_inverse(WORD_BASE), len(self.start) + 1)[at]
        return mix((self.sums[at + length] - self.sums[at]) * shift + np.uint64(length))

    def windows(self, length: int) -> np.ndarray:
        """Places where `length` words of one text begin."""
        n = len(self.start)
        if n < length:
            return np.zeros(0, np.int64)
        at = np.arange(n - length + 1)
        return at[self.first[1:][self.text_of[: n - length + 1]] >= at + length]

    def bytes_of(self, at: int, length: int) -> bytes:
        """Words joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at : at + length], self.end[at : at + length]))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = pc.fill_null(column, "").cast(pa.large_binary())
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Consecutive rows of a column with at most `limit` bytes (or one row): rows, bytes, offsets."""
    if not len(column):
        return
    data, offsets = flat(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield slice(row, stop), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `values` (one per word) for each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
