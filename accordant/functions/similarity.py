"""Set and text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant.functions.text import clean_set, let

# Bits used per machine word; the sum of two such words still fits a signed long.
_WORD = 62
_FULL = (1 << _WORD) - 1


def jaccard_sets(left: Column, right: Column) -> Column:
    """Jaccard of two arrays that already hold distinct members."""
    both = F.size(F.array_intersect(left, right))
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .otherwise(both / (F.size(left) + F.size(right) - both))
    )


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard over cleaned, lower-cased members; two empty sets are alike."""
    return let(
        F.struct(clean_set(left, lower=True).alias("a"), clean_set(right, lower=True).alias("b")),
        lambda p: jaccard_sets(p["a"], p["b"]),
    )


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _words(chars: Column) -> Column:
    """Numbers of the machine words that hold one bit for each character."""
    return F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / _WORD).cast("int"))


def _masks(chars: Column) -> Column:
    """For each character the words with its places set."""
    distinct = F.array_distinct(chars)

    def word(d: Column, k: Column) -> Column:
        bits = F.transform(
            F.slice(chars, k * _WORD + 1, _WORD),
            lambda c, i: F.when(c == d, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
        )
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.transform(_words(chars), lambda k: word(d, k))))


def _next_words(v: Column, mask: Column) -> Column:
    """One character of the other text: add the hits word by word, with the carry going up."""

    def step(acc: Column, k: Column) -> Column:
        own = F.get(v, k)
        return let(
            F.struct(own.alias("v"), own.bitwiseAND(F.get(mask, k)).alias("hit")),
            lambda w: let(
                w["v"] + w["hit"] + acc["carry"],
                lambda total: F.struct(
                    F.shiftright(total, _WORD).alias("carry"),
                    F.array_append(acc["words"], total.bitwiseOR(w["v"] - w["hit"]).bitwiseAND(F.lit(_FULL))).alias("words"),
                ),
            ),
        )

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("words"))
    return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), start, step, lambda acc: acc["words"])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, bit-parallel over the characters of the shorter one."""
    shorter = F.when(F.length(a) < F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) < F.length(b), b).otherwise(a)

    def run(facts: Column) -> Column:
        chars, masks = facts["chars"], facts["masks"]
        full = F.transform(_words(chars), lambda _: F.lit(_FULL))

        def step(v: Column, c: Column) -> Column:
            return let(F.try_element_at(masks, c), lambda m: F.when(m.isNull(), v).otherwise(_next_words(v, m)))

        # A place of the shorter text that lost its bit is part of the subsequence.
        lost = F.transform(F.aggregate(_chars(longer), full, step), lambda w: _WORD - F.bit_count(w).cast("int"))
        return F.aggregate(lost, F.lit(0), lambda x, y: x + y)

    facts = let(_chars(shorter), lambda c: F.struct(c.alias("chars"), _masks(c).alias("masks")))
    return F.when((a == "") | (b == ""), F.lit(0)).when(a == b, F.length(a)).otherwise(let(facts, run))


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised insert/delete similarity 2*LCS/(len+len); two empty texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)
