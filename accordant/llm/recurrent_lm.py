"""LM scoring: a gated recurrent language model with a class-factored softmax, beside a unigram base.

Counts. All words of all training texts are counted by Spark; the table of counts grows with the
corpus and stays distributed. The HEAD most frequent words and the ends of texts are symbols of
their own; every other word belongs to one of TAILS classes by its last two bytes.

Model. A gated recurrent unit reads the symbols of a text and predicts the next one: first its class
(a block of head words of similar frequency, or a tail), then a head word within its class from
the same state. A tail word follows the smoothed counts within its tail, so every word has a
probability, and the known and unknown words of a text add up as in the unigram base.

Training. The training documents are dealt into `rounds` parts by a hash of id and text, and every one
is trained on once. In the round of its part, each task runs truncated backpropagation in numpy over
whole texts from common weights; then the tasks' weights are averaged by their numbers of tokens.
Biases begin at the counts, so the model begins as a unigram model.

Scoring. Every text is run from its first word to its end; the state is carried from window to
window, so no context is cut. Texts run side by side in lanes. Counts of the KNOWN most frequent
words go to the tasks (a table of bounded size); what a text holds beyond them is joined with the
table of counts.

Cases: null and empty texts are one token, the end; with no training text every word is unknown
and N is 0; repeated documents are each scored; a null id is not held out; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.quality_model import held_out
from accordant.llm.words import LOWER, Words, blocks, mix, small_batches
from accordant.session import fact_join, scratch_path

FOLDS = 10
HEAD = 1023
TAILS = 32
PER_CLASS = 32
KNOWN = 1 << 18
STATE = 24
EMBEDDING = 16
ROUNDS = 2
WINDOW = 24
LANES = 64
FLUSH_TOKENS = 2_000_000
END = np.uint64(0x2545F4914F6CDD1D)  # stands for the end of a text among the hashes of words
SMOOTH = 0.1
TOP = np.float32(80)  # logits end here, so that their exponentials don't overflow


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tails of all tokens of a block of texts, ends included, and where each text's begin."""
    lower = LOWER[data]
    words = Words(lower, offsets)
    first = words.first + np.arange(len(words.first))
    hashes = np.full(first[-1], END, np.uint64)
    tail = np.zeros(first[-1], np.int64)
    at = np.arange(len(words.start)) + words.text_of
    hashes[at] = words.hashes
    last = lower[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, lower[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    tail[at] = (mix(last * np.uint64(256) + before) % np.uint64(TAILS)).astype(np.int64)
    return hashes, tail, first


def count_tokens(docs: DataFrame) -> DataFrame:
    """(hash, tail, n) of the training texts, written once. docs: doc_id, held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                hashes, tail, _ = tokens(data, offsets)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(tail[first].astype(np.int32)), pa.array(n)], names=["hash", "tail", "n"]
                )

    path = scratch_path(docs.sparkSession, "counts")
    rows = docs.filter(~F.col("held_out")).select("text").mapInArrow(run, "hash long, tail int, n long")
    rows.groupBy("hash", "tail").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Vocabulary:
    """Symbols: the end and the head words by falling count, then the tails; and their classes."""

    def __init__(self, head: list[tuple[int, int]], end_count: int, tails: dict[int, tuple[int, int]], known: tuple[np.ndarray, np.ndarray]):
        words = np.array([h for h, _ in head], np.int64).view(np.uint64)
        self.counts = np.array([end_count, *(n for _, n in head)], np.float64)
        hashes = np.append(END, words)
        order = np.argsort(hashes)
        self.sorted, self.symbol_of = hashes[order], order
        self.heads = len(hashes)
        self.size = self.heads + TAILS
        self.classes = -(-self.heads // PER_CLASS)
        self.tail_n = np.array([tails.get(k, (0, 0))[0] for k in range(TAILS)], np.float64)
        self.tail_v = np.array([tails.get(k, (0, 0))[1] for k in range(TAILS)], np.float64)
        order = np.argsort(known[0])
        self.known, self.known_n = known[0][order], known[1][order]

    def symbols(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.heads - 1)
        return np.where(self.sorted[at] == hashes, self.symbol_of[at], self.heads + tail)

    def count_of(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of the known words; -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.known_n[at], -1)

    def tail_log(self) -> np.ndarray:
        """log10 of what the smoothed counts of a tail are divided by."""
        return np.log10(self.tail_n + SMOOTH * (self.tail_v + 1))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The vocabulary, and the numbers of tokens and of different tokens."""
    end = int(END.view(np.int64))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("hash") == end, F.col("n"))).alias("ends")).first()
    # The words above the count that at most KNOWN words reach; counts are told apart by steps of
    # 2^(1/16), of which there are at most 16 for each bit.
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = KNOWN, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    top = counts.filter(step >= least if least is not None else F.lit(False)).select("hash", "n").toPandas()  # at most KNOWN rows
    top = top.sort_values(["n", "hash"], ascending=[False, True])
    hashes, n = top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    words = np.flatnonzero(hashes != end)[:HEAD]
    head = list(zip(hashes[words].tolist(), n[words].tolist()))
    listed = counts.sparkSession.createDataFrame([(h,) for h, _ in head] + [(end,)], "hash long")
    rest = counts.join(F.broadcast(listed), "hash", "left_anti")  # at most HEAD + 1 rows
    tails = {r["tail"]: (r["n"], r["v"]) for r in rest.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    found = Vocabulary(head, total["ends"] or 0, tails, (hashes.view(np.uint64), n))
    return found, total["n"] or 0, total["v"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Weights of the recurrent model, in one flat array with named views."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        v = vocabulary
        self.v, self.first_tail = v, v.heads
        self.trained_tokens = 0
        shapes = {
            "embed": (v.size + 1, EMBEDDING), "wx": (EMBEDDING, 3 * STATE), "b": (3 * STATE,), "u": (STATE, 3 * STATE),
            "wc": (STATE, v.classes + TAILS), "bc": (v.classes + TAILS,),
            "wo": (v.classes, PER_CLASS, STATE), "bo": (v.classes, PER_CLASS),
        }
        sizes = {k: int(np.prod(s)) for k, s in shapes.items()}
        self.flat = np.zeros(sum(sizes.values()), np.float32) if flat is None else flat.astype(np.float32)
        self.w, at = {}, 0
        for k, s in shapes.items():
            self.w[k] = self.flat[at : at + sizes[k]].reshape(s)
            at += sizes[k]
        if flat is None:
            self.begin()

    def begin(self, seed: int = 11) -> None:
        rng, v, w = np.random.default_rng(seed), self.v, self.w
        w["embed"][:] = rng.normal(0, 0.3, w["embed"].shape)
        w["wx"][:] = rng.normal(0, EMBEDDING**-0.5, w["wx"].shape)
        w["u"][:] = rng.normal(0, 0.5 * STATE**-0.5, w["u"].shape)
        w["b"][:STATE] = 1  # keep the state at first
        padded = np.full(v.classes * PER_CLASS, -1.0)
        padded[: v.heads] = v.counts
        smooth = np.where(padded < 0, 0, padded + SMOOTH).reshape(v.classes, PER_CLASS)
        w["bo"][:] = np.where(smooth > 0, np.log(np.maximum(smooth, 1e-30)), -1e4)
        w["bo"] -= w["bo"].max(1, keepdims=True)
        w["bc"][:] = np.log(np.concatenate([smooth.sum(1), v.tail_n + SMOOTH * (v.tail_v + 1)]))
        w["bc"] -= w["bc"].max()
        w["wc"][:] = rng.normal(0, 0.05, w["wc"].shape)
        w["wo"][:] = rng.normal(0, 0.05, w["wo"].shape)

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.first_tail, symbol // PER_CLASS, self.v.classes + symbol - self.first_tail)

    def outputs(self, h: np.ndarray, target: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target symbol given its state, and the slope of their sum
        with respect to the states if `slopes` takes those of the weights."""
        w, kind = self.w, self.class_of(target)
        logits = h @ w["wc"]
        logits += w["bc"]
        np.minimum(logits, TOP, out=logits)  # the largest bias is 0 and states are within 1
        p = np.exp(logits)
        norm = p.sum(1)
        rows = np.arange(len(h))
        out = logits[rows, kind] - np.log(norm)
        dh = None
        if slopes is not None:
            p /= -norm[:, None]
            p[rows, kind] += 1
            slopes["wc"] += h.T @ p
            slopes["bc"] += p.sum(0)
            dh = p @ w["wc"].T
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.v.classes + 1))
        for c in range(self.v.classes):
            own = order[edges[c] : edges[c + 1]]
            if not len(own):
                continue
            x = h[own]
            inner = x @ w["wo"][c].T
            inner += w["bo"][c]
            np.minimum(inner, TOP, out=inner)
            q = np.exp(inner)
            norm = q.sum(1)
            word, rows = target[own] % PER_CLASS, np.arange(len(own))
            out[own] += inner[rows, word] - np.log(norm)
            if slopes is not None:
                q /= -norm[:, None]
                q[rows, word] += 1
                slopes["wo"][c] += q.T @ x
                slopes["bo"][c] += q.sum(0)
                dh[own] += q @ w["wo"][c]
        return out, dh

    def window(self, h: np.ndarray, inputs: np.ndarray, reset: np.ndarray, gates: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States after each step of a window, and what backpropagation needs."""
        w, trace = self.w, []
        states = np.empty((len(inputs), *h.shape), np.float32)
        u, resets = w["u"], reset.any(1)
        # `gates` holds what each symbol adds to the gates; without it, it is worked out from the weights.
        added = gates[inputs] if gates is not None else w["embed"][inputs] @ w["wx"] + w["b"]
        for t in range(len(inputs)):
            if resets[t]:
                h = np.where(reset[t][:, None], np.float32(0), h)
            a = added[t]
            uh = h @ u
            if gates is not None:
                zr, n = uh[:, : 2 * STATE], uh[:, 2 * STATE :]
                zr += a[:, : 2 * STATE]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                n *= zr[:, STATE:]
                n += a[:, 2 * STATE :]
                np.tanh(n, out=n)
                h = h - n
                h *= zr[:, :STATE]
                h += n
                states[t] = h
                continue
            zr = sigmoid(a[:, : 2 * STATE] + uh[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(a[:, 2 * STATE :] + r * uh[:, 2 * STATE :])
            trace.append((h, z, r, n, uh[:, 2 * STATE :]))
            h = n + z * (h - n)
            states[t] = h
        return states, trace

    def slopes(self, h: np.ndarray, inputs: np.ndarray, reset: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Slope of the mean log probability of a window, their sum, and the last states. Target -1 is none."""
        grad = Model(self.v, np.zeros_like(self.flat))
        g, w = grad.w, self.w
        states, trace = self.window(h, inputs, reset)
        seen = targets >= 0
        logp, dseen = self.outputs(states[seen], targets[seen], g)
        dout = np.zeros_like(states)
        dout[seen] = dseen
        carry = np.zeros_like(h)
        da = np.empty((len(inputs), len(h), 3 * STATE), np.float32)
        for t in reversed(range(len(inputs))):
            before, z, r, n, un = trace[t]
            d = dout[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            da[t] = np.concatenate([dz, dr, dn], 1)
            g["u"] += before.T @ du
            carry = np.where(reset[t][:, None], np.float32(0), d * z + du @ w["u"].T)
        flat = da.reshape(-1, 3 * STATE)
        x = inputs.reshape(-1)
        g["wx"] += w["embed"][x].T @ flat
        g["b"] += flat.sum(0)
        np.add.at(g["embed"], x, flat @ w["wx"].T)
        return grad.flat / max(1, int(seen.sum())), float(logp.sum()), states[-1]


def lanes(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt out over lanes, the longest first: the place of each text's first token in a
    table of steps by lanes, and the table's size."""
    ends = [(0, k) for k in range(width)]
    place = np.empty((len(lengths), 2), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        at, lane = heapq.heappop(ends)
        place[d] = at, lane
        heapq.heappush(ends, (at + int(lengths[d]), lane))
    return place, np.array([max(at for at, _ in ends), width])


def table_of(symbols: np.ndarray, first: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, resets, targets (-1: none) and token numbers as tables of steps by lanes."""
    lengths = np.diff(first)
    place, (steps, width) = lanes(lengths, width)
    text = np.repeat(np.arange(len(lengths)), lengths)
    nth = np.arange(len(symbols)) - first[text]
    row, lane = place[text, 0] + nth, place[text, 1]
    targets = np.full((steps, width), -1, np.int32)
    number = np.full((steps, width), -1, np.int32)
    targets[row, lane], number[row, lane] = symbols, np.arange(len(symbols))
    inputs = np.full((steps, width), start, np.int32)
    follows = nth > 0
    inputs[row[follows], lane[follows]] = symbols[np.flatnonzero(follows) - 1]
    reset = np.zeros((steps, width), bool)
    reset[place[:, 0], place[:, 1]] = True
    return inputs, reset, targets, number


def score_texts(model: Model, gates: np.ndarray, symbols: np.ndarray, first: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log probability of each token of the texts."""
    lengths = np.diff(first)
    longest = int(lengths.max())
    width = int(np.clip(len(symbols) // max(1, longest), 1, 512))
    inputs, reset, targets, number = table_of(symbols, first, width, model.v.size)
    out = np.zeros(len(symbols))
    h = np.zeros((width, STATE), np.float32)
    for t in range(0, len(inputs), window):
        states, _ = model.window(h, inputs[t : t + window], reset[t : t + window], gates)
        seen = targets[t : t + window] >= 0
        out[number[t : t + window][seen]] = model.outputs(states[seen], targets[t : t + window][seen])[0]
        h = states[-1]
    return out


def train_on(model: Model, symbols: np.ndarray, first: np.ndarray, rate: float, memory: dict) -> None:
    """One pass of truncated backpropagation over some texts, with Adam."""
    total = len(symbols)
    width = int(np.clip(total // (200 * WINDOW), 4, LANES))
    inputs, reset, targets, _ = table_of(symbols, first, width, model.v.size)
    h = np.zeros((width, STATE), np.float32)
    a, b = memory.setdefault("a", np.zeros_like(model.flat)), memory.setdefault("b", np.zeros_like(model.flat))
    for t in range(0, len(inputs), WINDOW):
        if not (targets[t : t + WINDOW] >= 0).any():
            break
        slope, _, h = model.slopes(h, inputs[t : t + WINDOW], reset[t : t + WINDOW], targets[t : t + WINDOW])
        memory["step"] = step = memory.get("step", 0) + 1
        a += 0.1 * (slope - a)
        b += 0.001 * (slope * slope - b)
        model.flat += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with about FLUSH_TOKENS tokens at a time, with their hashes, tails and text borders."""
    held, parts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        parts += [tokens(data, offsets) for _, data, offsets in blocks(batch.column(column))]
        size = sum(len(p[0]) for p in parts)
        if size >= FLUSH_TOKENS:
            yield held, *_joined(parts)
            held, parts = [], []
    if parts:
        yield held, *_joined(parts)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    first = np.concatenate([p[2][:-1] + k for p, k in zip(parts, at)] + [at[-1:]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), first


def trained(docs: DataFrame, found: Vocabulary, *, rounds: int = ROUNDS) -> Model:
    """The model, trained on all training texts where they are."""
    spark = docs.sparkSession
    model, seen = Model(found), 0
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((found, model.flat))
        rate = 4e-3 / (k + 1)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            found, flat = shared.value
            own, memory, seen = Model(found, flat.copy()), {}, 0
            for _, hashes, tail, first in gathered(batches, 0):
                train_on(own, found.symbols(hashes, tail), first, rate, memory)
                seen += len(hashes)
            if seen:
                yield pa.RecordBatch.from_pydict({"n": pa.array([seen]), "weights": pa.array([own.flat.tobytes()], pa.binary())})

        rows = docs.filter(~F.col("held_out") & (pick == k)).select("text").mapInArrow(run, "n long, weights binary")
        sums = rows.rdd.map(lambda r: (r["n"], r["n"] * np.frombuffer(r["weights"], np.float32).astype(np.float64)))
        total = sums.treeAggregate(
            (0, None), lambda a, b: (a[0] + b[0], b[1] if a[1] is None else a[1] + b[1]),
            lambda a, b: (a[0] + b[0], a[1] if b[1] is None else b[1] if a[1] is None else a[1] + b[1]),
        )
        if total[0]:
            model = Model(found, (total[1] / total[0]).astype(np.float32))
            seen += total[0]
    model.trained_tokens = seen
    return model


def score_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = count_tokens(rows)
    found, n, v = vocabulary(counts)
    model = trained(rows, found, rounds=rounds)
    shared = spark.sparkContext.broadcast((found, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, flat = shared.value
        model, part, row = Model(found, flat), TaskContext.get().partitionId(), 0
        gates = model.w["embed"] @ model.w["wx"] + model.w["b"]
        divisor = found.tail_log()
        for held, hashes, tail, first in gathered(batches, 2):
            symbols = found.symbols(hashes, tail)
            logp = score_texts(model, gates, symbols, first) / np.log(10)
            in_tail = symbols >= found.heads
            logp[in_tail] -= divisor[symbols[in_tail] - found.heads]
            count = found.count_of(hashes)
            known = count >= 0
            weight = np.where(known, np.log10(np.maximum(count, 0) + SMOOTH), 0)
            logp += np.where(in_tail, weight, 0)
            sums = np.zeros((3, len(hashes) + 1))
            np.cumsum([known, weight, logp], axis=1, out=sums[:, 1:])
            known_n, base, score = sums[:, first[1:]] - sums[:, first[:-1]]
            rest = np.flatnonzero(~known)
            text = np.searchsorted(first, rest, "right") - 1
            border = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
            at = 0
            for batch in held:
                own = slice(at, at + batch.num_rows)
                cut = border[at : at + batch.num_rows + 1]
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(hashes[rest[cut[0] : cut[-1]]].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:2], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(row, row + batch.num_rows)),
                        pa.array(np.diff(first)[own]), pa.array(known_n[own].astype(np.int64)), pa.array(base[own]), pa.array(score[own]), lists,
                    ],
                    names=["doc_id", "held_out", "part", "row", "n_tokens", "known", "base", "model", "rest"],
                )
                at, row = own.stop, row + batch.num_rows

    path = scratch_path(spark, "scores")
    schema = "doc_id long, held_out boolean, part int, row long, n_tokens long, known long, base double, model double, rest array<long>"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    scored = spark.read.parquet(path)
    rest = scored.select("part", "row", F.explode("rest").alias("hash")).groupBy("part", "row", "hash").agg(F.count("*").alias("times"))
    joined = fact_join(rest, counts.select("hash", "n"), ["hash"])
    more = joined.groupBy("part", "row").agg(
        F.sum("times").alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("more_log"),
    )
    per_token = float(np.log10(n + SMOOTH * (v + 1)))
    full = scored.drop("rest").join(more, ["part", "row"], "left")
    extra = F.coalesce(F.col("more_log"), F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )
