"""Token ids of whole texts through the tokenizers library, each distinct unit encoded once.

Both tokenizer families split a text into pieces before they merge bytes, so a text may be cut
into units at places where such a piece surely ends, and its ids are those of its units in turn:

* at ASCII white space. The byte tokenizer takes one blank into the word after it; the rest of a
  gap is a unit, its last character one of its own unless it is that blank. The word tokenizer
  drops white space;
* between an ASCII letter and an ASCII mark after it.

Units are found and hashed (64 bits) as arrays; a worker keeps the ids of the units it has met, in
a table of bounded size, and gives only new ones to the library. A text with other white space goes
to the byte tokenizer whole. tests/llm compares with the library on whole texts.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from accordant.llm.words import LOWER, NOT_SPACE, blocks, span_hashes

CACHE_UNITS = 800_000
UNITS_AT_ONCE = 4096

#: White space of the Unicode standard outside ASCII.
WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x30] = MARK[0x3A:0x41] = MARK[0x5B:0x61] = MARK[0x7B:0x7F] = True


def unit_spans(data: np.ndarray, offsets: np.ndarray, drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the units of a block of texts, in order. Empty texts have none."""
    n = len(data)
    inside = NOT_SPACE[data]
    begins = np.zeros(n + 1, bool)  # a unit begins here
    begins[offsets[:-1]] = True
    if n:
        begins[1:n] |= inside[1:] != inside[:-1]  # words and gaps
        begins[1:n] |= LETTER[data[:-1]] & MARK[data[1:]]
        if not drops_space:
            # Where a word begins in a text, what was the last character of the gap before it
            # parts from the gap; a blank moves over to the word.
            first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
            first = first[~np.isin(first, offsets)]
            begins[first - 1] = True
            begins[first[data[first - 1] == 0x20]] = False
    start = np.flatnonzero(begins[:n])
    end = np.append(start[1:], n)
    if drops_space:
        word = inside[start]
        return start[word], end[word]
    return start, end


class Encoder:
    """Token ids of texts, with a table of the units met so far."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = drops_space
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the units met, in order
        self.row = np.zeros(0, np.int64)  # and their rows in the tables below
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Add new units; their hashes are in order."""
        sizes, parts = np.zeros(len(units), np.int64), []
        for k in range(0, len(units), UNITS_AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(units[k : k + UNITS_AT_ONCE], add_special_tokens=False)]
            sizes[k : k + len(found)] = own = [len(x) for x in found]
            parts.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(own)))
        flat = np.concatenate(parts)
        have, rows = len(self.row), len(self.row) + len(units)
        while rows > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[have:rows] = sizes
        self.first[have:rows] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.row = np.insert(self.row, place, np.arange(have, rows))

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, one after another, and the place where each text's begin."""
        if self.drops_space:
            data = LOWER[data]  # as the tokenizer does first
        start, end = unit_spans(data, offsets, self.drops_space)
        hashes, place, unit = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            raw, first = data.tobytes(), place[new]
            self.learn(hashes[new], [raw[s:e].decode() for s, e in zip(start[first].tolist(), end[first].tolist())])
            at = np.searchsorted(self.known, hashes)
        row = self.row[at][unit]
        sizes = self.size[row]
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.repeat(self.first[row] - (stop - sizes), sizes) + np.arange(total)]
        return ids, np.append(0, stop)[np.searchsorted(start, offsets)]

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[np.ndarray] = []
        for _, data, offsets in blocks(column):
            ids, at = self.block(data, offsets)
            rows = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            if not self.drops_space:
                wide = (data >= 0xC2) & (data <= 0xE3)  # where the characters of WIDE_SPACE begin
                for d in np.unique(np.searchsorted(offsets, np.flatnonzero(wide), "right") - 1).tolist():
                    text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
                    if WIDE_SPACE.search(text):
                        rows[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            out += rows
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The encoder of this worker process, kept between tasks."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]
