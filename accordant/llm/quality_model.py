"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Random indexing. Every word (a run of letters and digits, or of marks) falls into one of BUCKETS
   hash buckets, and every bucket has a fixed sparse vector of a few +1 and -1. A bucket's word
   vector is the sum of the sparse vectors of the words next to it, over all texts: tasks add up
   whole numbers, Spark adds up the tasks', and the result has BUCKETS rows at any corpus size.
2. Pooling. A document is the mean and the spread of the word vectors of all its words, the logarithms
   of the numbers of words and of different words, and the share of words equal to one of the two before.
3. A network with one hidden layer is trained with numpy on at most `max_train` labelled documents,
   those with the smallest hash of their id. Nothing but the text is an input.
4. Temperature. On a fifth of them, not trained on, one divisor of the network's output is chosen
   by likelihood, so that its probabilities are calibrated.

Only labels of documents that are not held out are read: held out is crc32(id as text) modulo
`folds` = 0.

Cases: a null or empty text pools to zeros and is scored like any other; labels that are neither
0 nor 1 or belong to no document are left out; a document with several labels counts as bad if one
is; with labels of one kind only, or none, every score is the smoothed share of good ones; a null
id is not held out; repeated documents get equal scores; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.words import NOT_SPACE, blocks, mix, small_batches, span_hashes

BUCKETS = 1 << 13
SIZE = 64
INPUTS = 2 * SIZE + 3
NONZERO = 4
NEIGHBOURS = 2
FOLDS = 5
MAX_TRAIN = 20_000
HIDDEN = 32
THRESHOLD = 0.3

#: 0 white space, 1 letters and digits (and all beyond ASCII), 2 marks.
CLASS = np.where(NOT_SPACE, 2, 0).astype(np.uint8)
CLASS[0x30:0x3A] = CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = CLASS[0x80:] = 1


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of a block of texts, and the text that it belongs to."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = CLASS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    word = kind[start] > 0
    start, end = start[word], end[word]
    return (span_hashes(data, start, end) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its nonzero entries."""
    seeds = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x1F83D9ABFB41BD6B)).reshape(BUCKETS, NONZERO)
    return (seeds % np.uint64(SIZE)).astype(np.int64), np.where(seeds >> np.uint64(63), 1, -1)


def held_out(doc: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc.cast("string")) % folds == 0, F.lit(False))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all buckets, from all texts; unit length, common direction removed."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * SIZE, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                bucket, text = word_buckets(data, offsets)
                for step in range(1, NEIGHBOURS + 1):
                    same = np.flatnonzero(text[step:] == text[:-step])
                    for a, b in ((bucket[same], bucket[same + step]), (bucket[same + step], bucket[same])):
                        for k in range(NONZERO):
                            total += np.bincount(a * SIZE + place[b, k], sign[b, k], BUCKETS * SIZE).astype(np.int64)
        rows = total.reshape(BUCKETS, SIZE)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(rows[used, k]) for k in range(SIZE))], names=["bucket", *(f"v{k}" for k in range(SIZE))]
        )

    schema = "bucket long, " + ", ".join(f"v{k} long" for k in range(SIZE))
    parts = docs.select(text_col).mapInArrow(count, schema)
    sums = parts.groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE)))
    out = np.zeros((BUCKETS, SIZE))
    found = sums.toPandas()  # at most BUCKETS rows
    if len(found):
        raw = found[[f"v{k}" for k in range(SIZE)]].to_numpy(np.float64)
        raw = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        raw -= raw.mean(0)
        out[found["bucket"].to_numpy()] = raw
    return out.astype(np.float32)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and how many and how varied its words are."""
    bucket, text = word_buckets(data, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.append(0, np.cumsum(n))
    out = np.zeros((len(n), INPUTS), np.float32)
    equal = np.zeros(len(bucket), bool)
    for lag in (1, 2):  # a mark may stand between
        equal[lag:] |= (bucket[lag:] == bucket[:-lag]) & (text[lag:] == text[:-lag])
    out[:, -3] = np.bincount(text, equal, len(n)) / np.maximum(n, 1)
    out[:, -1] = np.log1p(n)
    for d in np.flatnonzero(n).tolist():
        own, times = np.unique(bucket[first[d] : first[d + 1]], return_counts=True)
        share = (times / n[d]).astype(np.float32)
        mean = share @ vectors[own]
        out[d, :SIZE] = mean
        out[d, SIZE : 2 * SIZE] = np.sqrt(np.maximum(share @ vectors[own] ** 2 - mean**2, 0))
        out[d, -2] = np.log1p(len(own))
    return out


@dataclasses.dataclass
class Network:
    """A two-layer network with its input scaling and temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, *, hidden: int = HIDDEN, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the rows that are not for calibration, then the temperature on those that are."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(
        x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1]),
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))),
    )
    if len(np.unique(y)) < 2:
        return net
    z, target = ((x - net.mean) / net.scale)[~calibrate], y[~calibrate]
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(max(epochs, min(400, 40_000 // max(1, len(z))))):
        order = rng.permutation(len(z))
        for rows in np.array_split(order, max(1, len(z) // 128)):
            a, t = z[rows], target[rows]
            h = np.tanh(a @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -60, 60))) - t) / len(rows)
            back = np.outer(error, weights[2]) * (1 - h * h)
            slopes = [a.T @ back + decay * weights[0], back.sum(0), h.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    own = calibrate if calibrate.any() and len(np.unique(y[calibrate])) == 2 else np.ones(len(y), bool)
    logits = net.logits(x[own])
    choices = np.geomspace(0.25, 8, 61)
    net.temperature = float(min(choices, key=lambda t: loss(logits / t, y[own])))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, label_id: str, label_col: str, folds: int, max_train: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled vectors, labels and the calibration marks of at most `max_train` documents."""
    marks = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull() & ~held_out(F.col(label_id), folds))
        .groupBy(F.col(label_id).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_train)
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(2)):
                x = pool(data, offsets, shared.value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0)[rows.start : rows.stop],
                        "label": batch.column(1)[rows.start : rows.stop],
                        "x": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()),
                    }
                )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = own.join(F.broadcast(marks), "id").select("id", "label", "text")  # at most `max_train` ids
    found = joined.mapInArrow(run, "id long, label int, x binary").dropDuplicates(["id"]).toPandas().sort_values("id")
    x = np.frombuffer(b"".join(found["x"]), "<f4").reshape(-1, INPUTS)
    ids = found["id"].to_numpy(np.int64).view(np.uint64)
    return x, found["label"].to_numpy(), mix(ids) % np.uint64(5) == 0


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", folds: int = FOLDS, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    vectors = word_vectors(docs, text_col)
    net = train(*labelled_sample(docs, labels, vectors, id_col, text_col, label_id, label_col, folds, max_train))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            scores = [net.scores(pool(data, offsets, vectors)) for _, data, offsets in blocks(batch.column(2))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), text_col)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
