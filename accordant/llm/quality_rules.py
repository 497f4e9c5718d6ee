"""Quality rules: fixed limits, then a decision list learned from labelled statistics.

Every statistic is a built-in expression over the whole text. The decision list is learned by
sequential covering (as in IREP and RIPPER):

* Thresholds are quantiles of each statistic over all labelled documents that the fixed limits
  keep; a document's statistics become the numbers of the thresholds below them.
* Grow: starting from all documents not yet covered, add the condition (statistic above or not
  above a threshold) with the largest information gain for bad documents, until no good one is
  left, nothing is gained, or the rule has `max_conditions`.
* Prune: on a third of the documents, set aside by a hash of their id, cut the rule back to
  its best beginning by (bad - good) / (bad + good).
* Keep the rule while its share of bad documents there is at least `min_precision`, set its
  documents aside, and go on.

Each step is one aggregation that returns at most a count for each statistic and threshold. The
rules become one ordered CASE expression: the first rule that holds names the verdict.

Cases: a null text has no words; a statistic of a text without words is 0, so there is no division
by zero; such texts fail the fixed limits; with no labels, or of one kind only, no rule is
learned; several labels of a document count as bad if one is; a document with a null id has no
label; repeated documents are each judged. Other columns may have any names: the expressions'
own columns begin with `__q_`.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.session import fact_join, scratch_path

P = "__q_"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FEATURES = (
    "words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share",
    "repeat_share", "dup_line_share", "distinct_share", "words_per_line", "letterless_share",
)
QUANTILES = (0.001, 0.01, 0.02, 0.05, *(k / 32 for k in range(2, 31)), 0.95, 0.98, 0.99, 0.999)


@dataclasses.dataclass(frozen=True)
class Condition:
    """A statistic above (or, if not, at or below) a threshold."""

    feature: str
    threshold: float
    above: bool

    def expression(self) -> Column:
        value = F.col(P + self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def characters(text: Column, other: str) -> Column:
    """How many characters are left when all matches of `other` are taken out."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the statistics of the whole text in columns that begin with P."""

    def c(name: str) -> Column:
        return F.col(P + name)

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumns({P + "list": F.array_remove(F.split(text, SPACE, -1), ""), P + "lines": lines})
    places = F.sequence(F.lit(1), F.size(c("list")) - (WINDOW - 1))
    hashed = split.withColumns(
        {
            P + "runs": F.when(
                F.size(c("list")) >= WINDOW, F.transform(places, lambda k: F.xxhash64(F.slice(c("list"), k, WINDOW)))
            ),
            P + "words": F.size(c("list")).cast("long"),
            P + "word_chars": F.length(F.array_join(c("list"), "")).cast("long"),
            P + "distinct": F.size(F.array_distinct(c("list"))),
            P + "n_lines": F.size(c("lines")),
            P + "dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            P + "symbols": characters(text, r"[^#*$%&|<>]+"),
            P + "upper": characters(text, r"[^A-Z]+"),
            P + "digits": characters(text, r"[^0-9]+"),
            P + "marks": characters(text, r"[^!?|~^=_]+"),
            P + "letterless": F.size(F.filter(c("list"), lambda w: ~w.rlike(r"[\p{L}0-9]"))),
        }
    ).drop(P + "list", P + "lines")
    # Only texts with a repeated run sort their runs: equal ones become neighbours, and the places
    # of those that have an equal neighbour cover the repeated words.
    repeats = F.size(F.array_distinct(c("runs"))) < F.size(c("runs"))
    ordered = hashed.withColumn(
        P + "sorted",
        F.when(repeats, F.array_sort(F.transform(c("runs"), lambda h, k: F.struct(h.alias("h"), k.alias("k"))))),
    ).drop(P + "runs")

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(c("sorted"), k - 1)["h"], F.get(c("sorted"), k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    found = ordered.withColumn(
        P + "places", F.sort_array(F.transform(F.filter(c("sorted"), twice), lambda x: x["k"]))
    ).drop(P + "sorted")
    n = F.size(c("places"))
    gaps = F.zip_with(
        F.slice(c("places"), 1, n - 1), F.slice(c("places"), 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long")
    )
    covered = F.when(n > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda total, gap: total + gap)).otherwise(F.lit(0).cast("long"))
    counted = found.withColumn(P + "repeat_words", covered).drop(P + "places")

    def share(part: str, whole: str) -> Column:
        return F.when(c(whole) > 0, c(part).cast("double") / c(whole)).otherwise(F.lit(0.0))

    return counted.withColumns(
        {
            P + "base_failed": (c("words") < MIN_WORDS) | (100 * c("repeat_words") > MAX_REPEAT_PERCENT * c("words")),
            P + "word_length": share("word_chars", "words"),
            P + "symbol_share": share("symbols", "word_chars"),
            P + "upper_share": share("upper", "word_chars"),
            P + "digit_share": share("digits", "word_chars"),
            P + "mark_share": share("marks", "words"),
            P + "repeat_share": share("repeat_words", "words"),
            P + "dup_line_share": share("dup_lines", "n_lines"),
            P + "distinct_share": share("distinct", "words"),
            P + "words_per_line": share("words", "n_lines"),
            P + "letterless_share": share("letterless", "words"),
            P + "row": F.monotonically_increasing_id(),
        }
    )


def passes_limits() -> Column:
    """What the fixed limits keep.

    The row number keeps Spark from moving a filter below the statistics, which would put their
    whole definitions, nested, in its place.
    """
    return ~F.col(P + "base_failed") & (F.col(P + "row") >= 0)


def labelled_statistics(stats: DataFrame, labels: DataFrame, id_col: str, label_id: str, label_col: str) -> DataFrame:
    """Statistics of the labelled documents that the fixed limits keep: FEATURES, bad, prune; written once."""
    marks = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(label_id).alias(P + "id")
    ).agg((F.min(label_col) == 0).alias("bad"))
    rows = stats.filter(passes_limits()).select(
        F.col(id_col).alias(P + "id"), *(F.col(P + f).cast("double").alias(f) for f in FEATURES)
    )
    path = scratch_path(stats.sparkSession, "labelled")
    fact_join(rows, marks, [P + "id"], "inner").withColumn(
        "prune", F.pmod(F.xxhash64(P + "id"), F.lit(3)) == 0
    ).drop(P + "id").write.parquet(path)
    return stats.sparkSession.read.parquet(path)


def gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn_rules(
    labelled: DataFrame, *, max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.9, min_support: int = 5
) -> list[Rule]:
    """The decision list: rules for bad documents, in order."""
    spark = labelled.sparkSession
    total = labelled.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return []
    quantiles = labelled.agg(*(F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES)).first()
    thresholds = {f: sorted(set(quantiles[f])) for f in FEATURES}

    def bin_of(f: str) -> Column:
        steps = [F.when(F.col(f) > F.lit(t), 1).otherwise(0) for t in thresholds[f]]
        out = steps[0]
        for step in steps[1:]:
            out = out + step
        return out.alias(f)

    path = scratch_path(spark, "binned")
    labelled.select("bad", "prune", *(bin_of(f) for f in FEATURES)).write.parquet(path)
    binned = spark.read.parquet(path)

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for x in rule:
            k = thresholds[x.feature].index(x.threshold)
            out = out & (F.col(x.feature) > k if x.above else F.col(x.feature) <= k)
        return out

    def counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """For each feature and bin: bad and good documents."""
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES))).alias("x")
        grouped = rows.select("bad", pairs).groupBy("x.feature", "x.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        for r in grouped.collect():  # at most a row for each threshold
            out[r["feature"]][r["bin"]] = (r["bad"], r["good"])
        return out

    rules: list[Rule] = []
    while len(rules) < max_rules:
        uncovered = binned
        for rule in rules:
            uncovered = uncovered.filter(~holds(rule))
        grown: Rule = ()
        grow = uncovered.filter(~F.col("prune"))
        while len(grown) < max_conditions:
            table = counts(grow.filter(holds(grown)))
            bad = sum(b for b, _ in table[FEATURES[0]].values())
            good = sum(g for _, g in table[FEATURES[0]].values())
            if not bad or not good:
                break
            best, found = 0.0, None
            for f in FEATURES:
                under = [0, 0]
                for k, t in enumerate(thresholds[f]):
                    b, g = table[f].get(k, (0, 0))
                    under = [under[0] + b, under[1] + g]
                    for above, (b, g) in ((False, under), (True, (bad - under[0], good - under[1]))):
                        worth = gain(b, g, bad, good)
                        if b >= min_support and worth > best + 1e-9:
                            best, found = worth, Condition(f, t, above)
            if found is None:
                break
            grown = (*grown, found)
        if not grown:
            return rules
        kept = uncovered.filter("prune").agg(
            *(F.count_if(holds(grown[: k + 1]) & F.col("bad")).alias(f"bad{k}") for k in range(len(grown))),
            *(F.count_if(holds(grown[: k + 1]) & ~F.col("bad")).alias(f"good{k}") for k in range(len(grown))),
        ).first()
        worth = [(kept[f"bad{k}"] - kept[f"good{k}"]) / max(1, kept[f"bad{k}"] + kept[f"good{k}"]) for k in range(len(grown))]
        cut = worth.index(max(worth))
        seen = kept[f"bad{cut}"] + kept[f"good{cut}"]
        if not seen or kept[f"bad{cut}"] < min_precision * seen:
            return rules
        rules.append(grown[: cut + 1])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        condition = rule[0].expression()
        for x in rule[1:]:
            condition = condition & x.expression()
        out = F.when(condition, F.lit(" AND ".join(map(str, rule)))).otherwise(out)
    return out


def rule_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, the statistics of the fixed limits, base_failed, kept, and the rule that rejects."""
    names = ["words", "word_chars", "symbols", "dup_lines", "repeat_words", "base_failed", "row"]
    path = scratch_path(docs.sparkSession, "statistics")
    with_statistics(docs.select(id_col, text_col), text_col).select(
        id_col, *(P + n for n in dict.fromkeys([*names, *FEATURES]))
    ).write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    rules = learn_rules(labelled_statistics(stats, labels, id_col, label_id, label_col))
    rule = verdict(rules)
    return stats.select(
        F.col(id_col).alias("doc_id"),
        F.col(P + "words").alias("n_words"),
        F.col(P + "word_chars").alias("word_chars"),
        F.col(P + "symbols").alias("n_symbols"),
        F.col(P + "dup_lines").alias("n_dup_lines"),
        F.col(P + "repeat_words").alias("n_repeat_words"),
        F.col(P + "base_failed").alias("base_failed"),
        (~F.col(P + "base_failed") & rule.isNull()).alias("kept"),
        F.when(~F.col(P + "base_failed"), rule).alias("rejected_by"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """`docs` without those that the fixed limits or the learned rules reject.

    The statistics are worked out twice, for the rules and for the filter: that is cheaper than
    to carry the texts to their verdicts.
    """
    stats = with_statistics(docs.select(id_col, text_col), text_col)
    rules = learn_rules(labelled_statistics(stats, labels, id_col, label_id, label_col))
    kept = passes_limits() & verdict(rules).isNull()
    return with_statistics(docs, text_col).filter(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
