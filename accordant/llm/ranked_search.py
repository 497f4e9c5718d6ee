"""Ranked lexical search: every document scored for every item by dense blocked matrix products.

The items are taken in blocks of bounded size. For each block one pass over the documents counts in how
many each of its terms occurs, and a second one scores: a tile of documents becomes a dense matrix of impacts
(documents times those terms of the block that occur in the tile), its product with the matrix of weights
(terms times items) is one BLAS call, and the best k of the tile are merged into those of the task.

Scores are exact integers. An impact is below 10^6 and weights are known, so terms are cut into tiles whose
products sum to less than 2^53 in float64; tiles are added as 64-bit integers. Equal scores are told apart by
document id before anything is dropped, and a document as good as the k-th is always looked at.
Terms are found by 64-bit hashes and compared byte by byte. Each task sends k rows an item at most; they
are cut to k for each item and salt first, then for each item.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document
(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, where N documents with a term hold L terms, n of them
in this document.

Cases: a null or empty text, or one without a term, is no document of N and is never listed; an item
without terms, or whose terms no document holds, has no row; rows of one item_id are one item with the
terms of all, null being an id of its own; a null doc_id comes last among equal scores; repeated rows are documents
of their own, each listed; a very long text is a tile of its own; an empty table of either kind gives no row. Only the
named columns are read, so others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from accordant.llm.words import ALNUM, LOWER, Words, blocks, small_batches, span_hashes
from accordant.session import first_per_group

K = 50
CELLS = 1 << 21  # terms times items of a block of items; a single item may have more
COLUMNS = 1024  # terms of one matrix product
EXACT = 1 << 53
IMPACT_LIMIT = 10**6
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower-cased text
SALTS = 64


@dataclass
class ItemBlock:
    """Items of a block with their terms; `weights` is set once the documents are counted."""

    ids: list = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    pairs: list[tuple[int, int]] = field(default_factory=list)  # (term, item)
    weights: np.ndarray | None = None

    def add(self, item_id, words: list[bytes]) -> None:
        self.ids.append(item_id)
        self.pairs += [(self.terms.setdefault(w, len(self.terms)), len(self.ids) - 1) for w in words]

    @property
    def cells(self) -> int:
        return len(self.ids) * len(self.terms)

    def matrix(self, weight: np.ndarray) -> np.ndarray:
        """Terms times items; a term that an item does not have weighs nothing."""
        out = np.zeros((len(self.terms), len(self.ids)))
        at = np.array(self.pairs, np.int64)
        out[at[:, 0], at[:, 1]] = weight[at[:, 0]]
        return out


class Finder:
    """Which term of a block each word of some texts is."""

    def __init__(self, terms: list[bytes]):
        self.size = np.array([len(t) for t in terms])
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        hashes = span_hashes(self.data, self.start, self.start + self.size)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(terms):
            raise ValueError("two terms with one hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each word that is a term."""
        place = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == words.hashes)
        term = self.order[place[at]]
        same = self.size[term] == words.end[at] - words.start[at]
        at, term = at[same], term[same]
        for size in np.unique(self.size[term]):
            rows = np.flatnonzero(self.size[term] == size)
            span = np.arange(size)
            equal = (words.data[words.start[at[rows], None] + span] == self.data[self.start[term[rows], None] + span]).all(axis=1)
            if not equal.all():
                keep = np.ones(len(at), bool)
                keep[rows[~equal]] = False
                at, term = at[keep], term[keep]
        return words.text_of[at], term


def item_blocks(items: DataFrame, id_col: str, text_col: str, cells: int = CELLS) -> Iterator[ItemBlock]:
    """The items in blocks, read one partition after the other; no block is larger than `cells`, or one item."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    terms = items.select(F.col(id_col).alias("id"), term.alias("term")).distinct().sort("id", "term")
    found, own, words = ItemBlock(), None, []
    for row in terms.toLocalIterator(prefetchPartitions=True):
        if words and row["id"] != own:
            found.add(own, words)
            words = []
            if found.cells >= cells:
                yield found
                found = ItemBlock()
        own = row["id"]
        words.append(row["term"].encode())
    if words:
        found.add(own, words)
    if found.ids:
        yield found


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, ALNUM)


def count_terms(docs: DataFrame, text_col: str, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """N, L, and the documents that hold each term: one row a term and task, added before they are collected."""
    finder = docs.sparkSession.sparkContext.broadcast(Finder(terms))

    def run(batches):
        held, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                words = read_words(data, offsets)
                n_docs += int((words.count > 0).sum())
                n_terms += int(words.count.sum())
                text, term = finder.value.find(words)
                held += np.bincount(np.unique(text * len(terms) + term) % len(terms), minlength=len(terms))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[-2, -1], at]), "n": np.concatenate([[n_docs, n_terms], held[at]])})

    counted = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(terms))], np.int64)


def term_weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def length_norm(count: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with `count` terms; in whole numbers of any size where 64 bits might not do."""
    if 50 * n_docs * int(count.max(initial=0)) < 1 << 62:
        return 50 + 50 * n_docs * count // n_terms
    return np.array([50 + 50 * n_docs * int(c) // n_terms for c in count], np.int64)


def column_tiles(weight: np.ndarray, width: int = COLUMNS, exact: int = EXACT) -> Iterator[slice]:
    """Consecutive terms, `width` at most, whose weights times the largest impact stay below 2^53 in sum."""
    if len(weight) and int(weight.max()) * IMPACT_LIMIT >= exact:
        raise ValueError("a single weight is too large")
    start = 0
    while start < len(weight):
        fits = int(np.searchsorted(np.cumsum(weight[start : start + width]) * IMPACT_LIMIT, exact))
        yield slice(start, start + fits)
        start += fits


def tile_scores(block: ItemBlock, matrix: np.ndarray, words: Words, found: tuple[np.ndarray, np.ndarray], totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, scores): the texts of a tile that hold a term, and their scores as texts times items."""
    text, term = found
    rows, row = np.unique(text, return_inverse=True)
    columns, column = np.unique(term, return_inverse=True)
    m = length_norm(words.count[rows].astype(np.int64), *totals)
    scores = np.zeros((len(rows), len(block.ids)), np.int64)
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    for tile in column_tiles(block.weights[columns]):
        a, b = np.searchsorted(column, [tile.start, tile.stop])
        width = tile.stop - tile.start
        tf = np.bincount(row[a:b] * width + column[a:b] - tile.start, minlength=len(rows) * width).reshape(len(rows), width)
        impact = (10**9 * tf) // (1000 * tf + 20 * m[:, None])
        scores += (impact.astype(np.float64) @ matrix[columns[tile]]).astype(np.int64)
    return rows, scores


class Best:
    """The k best documents of each item met so far: highest score, then smallest id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        self.floor = np.ones(n_items, np.int64)  # a score below can't be among the k best

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        ids, null = np.concatenate([self.id, ids[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort([ids, null, -score, item])
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        item = item[rank < self.k]
        self.item, self.score, self.id, self.null = item, score[order], ids[order], null[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.floor[item[last]] = self.score[last]


def best_of_block(docs: DataFrame, block: ItemBlock, id_col: str, text_col: str, k: int, item_type: T.DataType) -> DataFrame | None:
    """item_id, doc_id, score: the k best of each task for each item of a block."""
    terms = list(block.terms)
    n_docs, n_terms, held = count_terms(docs, text_col, terms)
    if not held.any():
        return None
    block.weights = term_weights(n_docs, held)
    shared = docs.sparkSession.sparkContext.broadcast((block, Finder(terms)))
    arrow_type = to_arrow_type(item_type)

    def run(batches):
        own, finder = shared.value
        matrix, best = own.matrix(own.weights), Best(len(own.ids), k)
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for rows, data, offsets in blocks(batch.column(1)):
                words = read_words(data, offsets)
                found = finder.find(words)
                if len(found[0]):
                    text, scores = tile_scores(own, matrix, words, found, (n_docs, n_terms))
                    best.add(ids[rows][text], null[rows][text], scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.ids[x] for x in best.item.tolist()], arrow_type), pa.array(best.id, mask=best.null), pa.array(best.score)],
            names=["item_id", "doc_id", "score"],
        )

    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, *,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cells: int = CELLS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, all that score above 0 if fewer."""
    spark = small_batches(docs.sparkSession)
    item_type = items.schema[item_col].dataType
    found = [best_of_block(docs, block, id_col, text_col, k, item_type) for block in item_blocks(items, item_col, item_text_col, cells)]
    found = [part for part in found if part is not None]
    if not found:
        types = {"item_id": item_type, "rank": T.IntegerType(), "doc_id": T.LongType(), "score": T.LongType()}
        return spark.createDataFrame([], T.StructType([T.StructField(name, kind) for name, kind in types.items()]))
    best = found[0]
    for part in found[1:]:
        best = best.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = first_per_group(best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["item_id", "salt"], order, k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return salted.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)
