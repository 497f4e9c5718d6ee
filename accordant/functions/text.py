"""String and array expressions. Each takes columns and returns a column."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant import rules as R

# White space as the source data sees it: Unicode white space plus the four ASCII separators.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def any_of(words: Sequence[str]) -> str:
    """A pattern that matches any of the words literally."""
    return "|".join(re.escape(word) for word in words)


def has_any(text: Column, words: Sequence[str]) -> Column:
    """True if one of the words occurs in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "　", " "), _SPACE, " "))


def strip_text(c: Column) -> Column:
    """Remove white space at both ends only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def coerce_cell(c: Column, data_type: str = "string") -> Column:
    if data_type.startswith("timestamp") or data_type == "date":
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return clean_text(c.cast("string"))


def title_key(c: Column) -> Column:
    return F.lower(F.replace(clean_text(c), F.lit(" "), F.lit("")))


def header_key(text: str) -> str:
    """Header names are matched without blanks and case."""
    return "".join(text.split()).lower()


def normalize_company(c: Column, suffixes: Sequence[str] = R.COMPANY_SUFFIXES) -> Column:
    """Drop blanks and case, then at most one legal suffix; the first listed match wins."""

    def strip_one(name: Column) -> Column:
        result = None
        for suffix in suffixes:
            test = name.endswith(suffix.lower()) & (F.length(name) > len(suffix))
            cut = F.substring(name, F.lit(1), F.length(name) - len(suffix))
            result = F.when(test, cut) if result is None else result.when(test, cut)
        return name if result is None else result.otherwise(name)

    return let(F.lower(F.replace(clean_text(c), F.lit(" "), F.lit(""))), strip_one)


def split_values(c: Column, separators: str = R.VALUE_SEPARATORS) -> Column:
    parts = F.transform(F.split(clean_text(c), separators), clean_text)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def clean_set(values: Column, lower: bool = False) -> Column:
    """Sorted set of the cleaned, non-empty members of an array."""
    cleaned = F.transform(
        F.coalesce(values, F.array().cast("array<string>")),
        lambda x: F.lower(clean_text(x)) if lower else clean_text(x),
    )
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def list_key(values: Column) -> Column:
    """Deterministic text of an array; '' when it has no members."""
    return F.when(F.size(values) > 0, F.to_json(values)).otherwise("")


def display_list(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " / "), F.lit(""))


def is_missing(c: Column) -> Column:
    """Null, blank, or the text of an empty JSON value."""
    blank = F.coalesce(strip_text(c), F.lit(""))
    return blank.isin("", '""', "[]", "{}", "null")


def normalize_claim(field: Column, c: Column, list_fields: Sequence[str] = R.LIST_FIELDS) -> Column:
    """Comparable text of a scalar claim; list claims go through `normalize_claim_list`."""
    from accordant.functions.url import normalize_url

    return (
        F.when(field == "company", normalize_company(c))
        .when(field == "title", title_key(c))
        .when(field.isin(*R.URL_FIELDS), normalize_url(c))
        .otherwise(clean_text(c))
    )


def normalize_claim_list(values: Column) -> Column:
    return list_key(clean_set(values))


def contains_term(text: Column, term: str) -> Column:
    """Whole-word match for ASCII alphanumeric terms, plain containment for the rest."""
    if term.isascii() and term.isalnum():
        return text.rlike(f"(?iu)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])")
    return F.lower(text).contains(term.lower())


def tag_text(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Sorted labels whose dictionary has at least one term in the text."""
    hits = []
    for label in sorted(dictionary):
        hit = F.lit(False)
        for term in dictionary[label]:
            hit = hit | contains_term(text, term)
        hits.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def fold_category(c: Column, folding: Sequence[tuple[str, Sequence[str]]]) -> Column:
    text = F.lower(strip_text(c))
    result = F.when(text == "", F.lit(""))
    for label, markers in folding:
        result = result.when(has_any(text, markers), F.lit(label))
    return result.otherwise(text)


def extract_years(values: Column, pattern: str = r"(?U)(?:19|20)\d{2}") -> Column:
    """Sorted set of the first year in each member."""
    found = F.transform(values, lambda v: F.regexp_extract(v, pattern, 0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y != "")))


def rank_of(values: Column, ranks: Sequence[tuple[str, int]], exact: bool = False) -> Column:
    """Ranks of all names found in the members, ascending and distinct."""

    def hit(name: str, rank: int) -> Column:
        return F.when(
            F.exists(values, lambda v: (v == name) if exact else v.contains(name)), F.lit(rank)
        )

    return F.array_sort(F.array_compact(F.array(*[hit(name, rank) for name, rank in ranks])))


def line_spans(text: Column, bullet_chars: str = R.FactRules.bullet_chars) -> Column:
    """Lines of a text as array<struct<start,end,evidence>> with offsets into the text.

    Offsets are prefix sums of line lengths. They are taken in blocks of about sqrt(n) lines so
    that a very long text stays far from quadratic, and nothing is exploded or shuffled.
    """
    lead = "^[" + re.escape(bullet_chars).replace("\\ ", " ") + "]*"

    def build(lines: Column) -> Column:
        lens = F.transform(lines, lambda x: F.length(x) + 1)

        def with_lens(ls: Column) -> Column:
            return let(
                F.greatest(F.ceil(F.sqrt(F.size(ls).cast("double"))).cast("int"), F.lit(1)),
                lambda b: with_block(ls, b),
            )

        def add(acc: Column, x: Column) -> Column:
            return acc + x

        def with_block(ls: Column, b: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / b).cast("int"))
            sums = F.transform(blocks, lambda k: F.aggregate(F.slice(ls, k * b + 1, b), F.lit(0), add))
            return let(sums, lambda s: with_sums(ls, b, blocks, s))

        def with_sums(ls: Column, b: Column, blocks: Column, s: Column) -> Column:
            before = F.transform(blocks, lambda k: F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), add))
            return let(before, lambda o: spans(ls, b, o))

        def spans(ls: Column, b: Column, o: Column) -> Column:
            def one(line: Column, i: Column) -> Column:
                block = F.floor(i / b).cast("int")
                offset = F.get(o, block) + F.aggregate(
                    F.slice(ls, block * b + 1, i - block * b), F.lit(0), add
                )
                body = F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", "")
                evidence = F.regexp_replace(body, lead, "")
                start = offset + F.length(body) - F.length(evidence)
                return F.struct(
                    start.cast("int").alias("start"),
                    (start + F.length(evidence)).cast("int").alias("end"),
                    evidence.alias("evidence"),
                )

            return F.filter(F.transform(lines, one), lambda x: x["evidence"] != "")

        return let(lens, with_lens)

    return let(F.split(text, "[\r\n]"), build)


def fact_label(evidence: Column, fallback: str | Column, rules: R.FactRules = R.FactRules()) -> Column:
    """Heading before a colon if short enough, else the clipped line."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback

    def label(cleaned: Column) -> Column:
        heading = strip_text(F.split(cleaned, "[：:]", 2)[0])
        clipped = F.regexp_replace(F.substring(cleaned, 1, rules.label_max), "[，。；; ]+$", "")
        return (
            F.when(F.length(heading).between(rules.label_min, rules.label_max), heading)
            .when(
                cleaned != "",
                F.concat(clipped, F.when(F.length(cleaned) > rules.label_max, "…").otherwise("")),
            )
            .otherwise(fallback)
        )

    return let(strip_text(F.regexp_replace(evidence, r"(?U)^[#>*•\-\s]+", "")), label)


def formula_safe(c: Column) -> Column:
    """Prefix a quote if a spreadsheet would read the cell as a formula."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def canonical_json(c: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
