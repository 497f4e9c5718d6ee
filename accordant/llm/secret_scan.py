"""Secret scans: fixed patterns, and a test battery for randomness on other tokens.

Patterns find assignments, access keys and hexadecimal runs. Every other token of letters and
digits gets an inferred encoding (an alphabet and its character classes) and three tests of the
hypothesis that its characters are drawn at random from that alphabet:

* chi-squared: are the characters uniform over the alphabet?
* runs: does the class (digit, capital, small letter, mark) change as often as it should?
* serial correlation: does a character's place in the alphabet depend on the one before?

Fisher's method combines the p-values. Words, names and paths fail; keys do not. Which p-values
count as failed is settled by false-discovery control (Benjamini-Hochberg) over all tokens of the
corpus, apart for each encoding and class of lengths, since short tokens of many kinds pass by
chance. The control works on counts per stratum and p-value bin, a table of bounded size. A token
of fewer than MIN_BITS random bits is never reported.

Everything is a built-in expression over the row; no text is shuffled. Running sums and maxima go by
chunks of matches, so a text with very many matches takes little more than its share of time.

Cases: a null text is empty; a very long text is scanned whole like any other; a text without matches has the hash of the empty string and an
empty list; spans are counted in code points, end exclusive; repeated documents are each scanned;
an empty table gives no rows. Other columns pass through the redaction unread, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.words import fresh
from accordant.session import scratch_path

#: The patterns of the base kinds, in the order of their kinds.
ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: A token with a letter and a digit, as a whole.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide: name, pattern, alphabet, sizes of its character classes.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "ABCDEF", (10, 6)),
    ("base32", r"^[A-Z2-7]+=*$", CAPITALS + "234567", (26, 6)),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + CAPITALS, (10, 26)),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + CAPITALS + SMALL, (10, 26, 26)),
    ("base64", r"", DIGITS + CAPITALS + SMALL + "+/", (10, 26, 26, 2)),
)
MIN_BITS = 96
LEVEL = 0.05
BINS_PER_DECADE, LAST_BIN = 20, 400
LENGTHS = (24, 32, 48, 64)
MASK = "[SECRET]"
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used, inside further lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(values: Column) -> Column:
    """Consecutive pieces of CHUNK elements of an array."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))


def before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of places, the merged values before it (0 before the first).

    Appending to an array copies it, so chunks are merged first, and then the elements of each: with n
    elements the copies are n * CHUNK and (n / CHUNK)^2 small numbers instead of n^2.
    """

    def from_base(chunk: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    def by_chunks(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge))
        return F.flatten(F.zip_with(chunks, from_base(whole, F.lit(0)), from_base))

    return bound(values, lambda v: bound(chunked(v), by_chunks))


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, keep_text: bool = False) -> Column:
    """All matches from left to right as structs: start, kind, end (and the match).

    The pieces between the matches give their places, as running sums of lengths.
    """

    def placed(x: Column, at: Column) -> Column:
        first = at + x["skip"]
        fields = [first.alias("start"), F.lit(kind).alias("kind"), (at + x["long"]).alias("end")]
        return F.struct(*fields, x["match"].alias("match"))

    def from_matches(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        fields = lambda piece, match: F.struct(F.length(piece).alias("skip"), (F.length(piece) + F.length(match)).alias("long"), match.alias("match"))
        return bound(F.zip_with(pieces, found, fields), lambda rows: F.zip_with(rows, before(F.transform(rows, lambda x: x["long"]), plus), placed))

    empty = F.array().cast("array<struct<start: int, kind: int, end: int, match: string>>")
    out = bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, from_matches(found)).otherwise(empty))
    out = F.filter(out, lambda x: keep(x["match"])) if keep is not None else out
    return out if keep_text else F.transform(out, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def outside(tokens: Column, base: Column) -> Column:
    """The tokens that share no place with a base span.

    Both become events in the order of the text, spans at their starts and tokens at their ends: a token
    overlaps if the largest end of a span that starts before the token's end lies beyond its start.
    """
    none = F.lit(None).cast("string")
    event = lambda at, x, token: F.struct(at.alias("at"), F.lit(token).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["match"] if token == 0 else none).alias("match"))
    events = F.array_sort(F.concat(F.transform(tokens, lambda x: event(x["end"], x, 0)), F.transform(base, lambda x: event(x["start"], x, 1))))

    def free(ordered: Column) -> Column:
        ends = before(F.transform(ordered, lambda x: F.when(x["kind"] == 1, x["end"]).otherwise(0)), larger)
        seen = F.zip_with(ordered, ends, lambda x, end: F.struct(x.alias("x"), (end > x["start"]).alias("covered")))
        left = F.filter(seen, lambda y: (y["x"]["kind"] == 0) & ~y["covered"])
        return F.transform(left, lambda y: F.struct(y["x"]["start"].alias("start"), F.lit(3).alias("kind"), y["x"]["end"].alias("end"), y["x"]["match"].alias("match")))

    return bound(events, free)


def pieces_at(text: Column, ranges: Column) -> Column:
    """The pieces of a text at ascending ranges (start, end). Chunks of ranges are cut out first, since each cut reads its text from the beginning."""

    def of_chunk(chunk: Column) -> Column:
        origin = chunk[0]["start"]
        whole = F.substring(text, origin + 1, F.element_at(chunk, -1)["end"] - origin)
        return bound(whole, lambda part: F.transform(chunk, lambda r: F.substring(part, r["start"] - origin + 1, r["end"] - r["start"])))

    return F.flatten(F.transform(F.filter(chunked(ranges), lambda c: F.size(c) > 0), of_chunk))


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with a mask in the place of each span of a sorted array, overlapping spans as one."""

    def from_ends(x: Column) -> Column:
        rows, ends = x["rows"], x["ends"]
        gaps = F.filter(F.zip_with(rows, ends, lambda r, end: F.struct(end.alias("start"), r["start"].alias("end"))), lambda g: g["end"] >= g["start"])
        head = bound(gaps, lambda g: F.array_join(F.transform(pieces_at(text, g), lambda p: F.concat(p, F.lit(mask))), ""))
        return F.concat(head, F.substring(text, F.array_max(F.transform(rows, lambda r: r["end"])) + 1, F.length(text)))

    with_ends = bound(found, lambda rows: F.struct(rows.alias("rows"), before(F.transform(rows, lambda r: r["end"]), larger).alias("ends")))
    return F.when(F.size(found) > 0, bound(with_ends, from_ends)).otherwise(text)


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.least(F.abs(z), F.lit(35.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


def two_sided(z: Column) -> Column:
    return F.greatest(F.least(2 * normal_tail(z), F.lit(1.0)), F.lit(1e-250))


def upper_tail(z: Column) -> Column:
    return F.greatest(F.when(z > 0, normal_tail(z)).otherwise(1 - normal_tail(z)), F.lit(1e-250))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def by_encoding(number: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def with_fields(rows: Column, step: Callable[[Column], dict[str, Column]], keep: list[str]) -> Column:
    return F.transform(rows, lambda x: F.struct(*(x[c].alias(c) for c in keep), *(v.alias(c) for c, v in step(x).items())))


def judged(tokens: Column) -> Column:
    """An array of tokens (start, kind, end, match) with stratum and p-value for their matches.

    One step holds what the next ones use more than once, so no expression is worked out twice.
    """
    alphabets = [a for _, _, a, _ in ENCODINGS]
    shares = [[c / len(a) for c in classes] for _, _, a, classes in ENCODINGS]
    change = [1 - sum(p * p for p in x) for x in shares]
    twice = [sum(p * (1 - p) ** 2 for p in x) for x in shares]
    classes = "d" * 10 + "u" * 26 + "l" * 26 + "mm"

    def encoding(x: Column) -> dict[str, Column]:
        number = F.lit(len(ENCODINGS) - 1)
        for k in range(len(ENCODINGS) - 2, -1, -1):
            number = F.when(x["match"].rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(number)
        return {"encoding": number, "clean": F.regexp_replace(F.translate(x["match"], "-_", "+/"), "=", "")}

    def spelled(x: Column) -> dict[str, Column]:
        caseless = by_encoding(x["encoding"], [a.startswith(DIGITS) and SMALL not in a for a in alphabets])
        return {
            "n": F.length(x["clean"]).cast("double"),
            "k": by_encoding(x["encoding"], [float(len(a)) for a in alphabets]),
            "chars": F.split(F.when(caseless, F.upper(x["clean"])).otherwise(x["clean"]), "(?!^)", -1),
            "kinds": F.split(F.translate(x["clean"], DIGITS + CAPITALS + SMALL + "+/", classes), "(?!^)", -1),
        }

    def placed(x: Column) -> dict[str, Column]:
        alphabet = by_encoding(x["encoding"], alphabets)
        return {"places": F.transform(x["chars"], lambda c: F.instr(alphabet, c).cast("double") - (x["k"] + 1) / 2)}

    def neighbours(values: Column, f: Callable[[Column, Column], Column]) -> Column:
        return total(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), f))

    def counted(x: Column) -> dict[str, Column]:
        times = lambda c: F.size(F.filter(x["chars"], lambda y: y == c)).cast("double")
        return {
            "squares": total(F.transform(F.array_distinct(x["chars"]), lambda c: F.pow(times(c), F.lit(2.0)))),
            "changes": neighbours(x["kinds"], lambda a, b: (a != b).cast("double")),
            "steps": neighbours(x["places"], lambda a, b: a * b),
        }

    def tested(x: Column) -> dict[str, Column]:
        n, k = x["n"], x["k"]
        q = by_encoding(x["encoding"], change)
        spread = (n - 1) * (q * (1 - q)) + (n - 2) * (2 * (by_encoding(x["encoding"], twice) - q * q))
        return {
            "uniform": (x["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)),
            "runs": (x["changes"] - (n - 1) * q) / F.sqrt(spread),
            "serial": x["steps"] / ((k * k - 1) / 12) / F.sqrt(n - 1),
        }

    def halved(x: Column) -> dict[str, Column]:
        return {"half": -(F.log(upper_tail(x["uniform"])) + F.log(two_sided(x["runs"])) + F.log(two_sided(x["serial"])))}

    def combined(x: Column) -> dict[str, Column]:
        bucket = F.lit(0)
        for length in LENGTHS:
            bucket = bucket + F.when(x["n"] >= length, 1).otherwise(0)
        half = x["half"]
        p = F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-250))
        return {"stratum": F.concat_ws(":", by_encoding(x["encoding"], [e[0] for e in ENCODINGS]), bucket), "p": p}

    span = ["start", "kind", "end"]
    steps = [
        (encoding, [*span, "match"]),
        (spelled, [*span, "encoding"]),
        (placed, [*span, "encoding", "n", "k", "chars", "kinds"]),
        (counted, [*span, "encoding", "n", "k"]),
        (tested, [*span, "encoding", "n"]),
        (halved, [*span, "encoding", "n"]),
        (combined, span),
    ]
    out = tokens
    bits = [math.log2(len(a)) for a in alphabets]
    for step, keep in steps:
        out = with_fields(out, step, keep)
        if step is encoding:
            out = F.filter(out, lambda x: F.length(x["clean"]) * by_encoding(x["encoding"], bits) >= MIN_BITS)
    return out


def with_spans(docs: DataFrame, text_col: str, base: str, tokens: str) -> DataFrame:
    """`docs` with two more columns: spans of the patterns, and judged tokens outside them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= MIN_VALUE
    patterns = F.concat(spans(text, ASSIGN, 0, value), spans(text, ACCESS, 1), spans(text, HEX, 2))
    based = docs.withColumn(base, F.array_sort(patterns))
    free = outside(spans(text, TOKEN, 3, keep_text=True), F.col(base))
    return based.withColumn(tokens, judged(free))


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int"), F.lit(LAST_BIN))


def failing_bins(found: DataFrame, tokens: str, level: float = LEVEL) -> dict[str, int]:
    """For each stratum the first bin of p-values that counts as not random.

    Benjamini-Hochberg with p rounded up to its bin. The counts are at most a row for each stratum
    and bin, whatever the corpus.
    """
    judgements = found.select(F.explode(tokens).alias("x"))
    counts: dict[str, dict[int, int]] = {}
    for r in judgements.groupBy("x.stratum", bin_of(F.col("x.p")).alias("bin")).count().collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    out = {}
    for stratum, bins in counts.items():
        m, below, first = sum(bins.values()), 0, LAST_BIN + 1
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) <= level * below / m:
                first = b
        out[stratum] = first
    return out


def random_spans(tokens: str, failing: dict[str, int]) -> Column:
    """The spans of tokens that still count as random."""

    def random(x: Column) -> Column:
        first = F.lit(LAST_BIN + 1)
        for stratum, b in failing.items():
            first = F.when(x["stratum"] == stratum, F.lit(b)).otherwise(first)
        return bin_of(x["p"]) < first

    return F.transform(F.filter(tokens, random), lambda x: F.struct(x["start"], x["kind"], x["end"]))


def as_text(found: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    spark = docs.sparkSession
    path = scratch_path(spark, "spans")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with_spans(own, "text", "base", "tokens").drop("text").write.parquet(path)
    found = spark.read.parquet(path)
    extra = random_spans("tokens", failing_bins(found, "tokens", level))
    base = F.col("base")

    def n(kind: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.array_sort(F.concat(base, extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", level: float = LEVEL, mask: str = MASK) -> DataFrame:
    """`docs` with every span, overlapping ones as one, replaced by a mask.

    The battery runs once over the corpus for its cut-offs and once for the texts, which is
    cheaper than to carry the texts from one to the other. A null text stays null.
    """
    base, tokens = fresh(docs, "base", "tokens")
    failing = failing_bins(with_spans(docs.select(text_col), text_col, base, tokens).select(tokens), tokens, level)
    marked = with_spans(docs, text_col, base, tokens)
    found = F.array_sort(F.concat(base, random_spans(tokens, failing)))
    cleaned = bound(found, lambda x: masked(F.col(text_col), x, mask))
    return marked.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
