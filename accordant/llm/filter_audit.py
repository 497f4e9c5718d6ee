"""Filter interaction audit: what each filter removes, in every order of the filters, by a recursive CTE.

Each document becomes a mask with one bit for each filter that it fails. Documents are counted by
part and mask, at most 2^n cells a part, and from there on only cells move. A recursive common table
expression starts from the empty prefix, extends each prefix of filters with every letter that it
does not use yet, joins the cells of the part and carries the bits applied so far; each level of the
recursion emits the metrics of its step. A prefix is worked out once for all orders that begin with it
(5 letters: 325 prefixes for 600 steps).

A document fails E if its whole text equals that of a smaller doc_id. Texts meet by their SHA-256,
combined before the shuffle, so a text held by a third of all rows costs one line a task.

Cases: a null text counts as empty; an empty text fails A only, and E beside an earlier empty one (B and C
compare 0 with 0); a very long text stays in its row. A null doc_id has no label, fails E never
and makes no other fail; rows of one doc_id and text are no copies of each other, each is counted. A null
part counts as the empty string, together with parts that are empty. Of several labels of one doc_id the
largest counts; a null label counts as 0. An empty table has no part and gives no row. Only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.session import fact_join, scratch_path

WORDS = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT = 65  # of 100 words
MAX_CAPITALS = 5  # of 100 code points
MARKS = "[#$%&*|]"
MAX_FILTERS = 7  # orders grow with the factorial


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone, by letter."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT * n,
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def copies(rows: DataFrame) -> DataFrame:
    """Add `copy`: whether a smaller id has the same digest. rows: id, digest."""
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    return fact_join(rows, first, ["digest"]).withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))


def judged(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, mask, good, toxic) for each document; bit k of the mask stands for the k-th letter of ABCDE."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = text_filters(text)
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(rules.values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        bits.alias("bits"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marked = fact_join(copies(rows), known, ["id"])
    return marked.select(
        "part",
        (F.col("bits") + F.when(F.col("copy"), 1 << len(rules)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def mask_cells(rows: DataFrame) -> DataFrame:
    """(part, cells): for each part its masks with counts of documents, good and toxic ones, 2^n at most."""
    counted = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _total(field: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (s, x) -> s + x.{field})"


def prefix_steps(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The metrics of the last step of every prefix of every order, for each part.

    cells: as mask_cells gives them. The recursion has one level for each filter.
    """
    if not 0 < len(set(letters)) == len(letters) <= MAX_FILTERS:
        raise ValueError(f"one to {MAX_FILTERS} different letters")
    spark = cells.sparkSession
    # Rows of the recursion are parts times prefixes, so their number is bounded by the output, not by a constant.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    fails, passed = "x.mask & bit <> 0", "x.mask & applied = 0"
    named = ", ".join(f"named_struct('letter', '{letter}', 'bit', {1 << k})" for k, letter in enumerate(letters))
    return spark.sql(
        f"""
        WITH RECURSIVE steps(part, prefix, step, filter, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
          SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
          UNION ALL
          SELECT s.part, concat(prefix, letter), step + 1, letter, applied | bit,
            {_total("n", "x.mask & (applied | bit) = 0")},
            {_total("n", f"{fails} AND {passed}")},
            {_total("n", f"{fails} AND NOT {passed}")},
            {_total("n", "x.mask = bit")},
            {_total("good", f"{fails} AND {passed}")},
            {_total("toxic", f"{fails} AND {passed}")}
          FROM (
            SELECT part, prefix, step, applied, unused.letter, unused.bit
            FROM (SELECT part, prefix, step, applied, explode(filter(array({named}), l -> applied & l.bit = 0)) AS unused FROM steps)
          ) s JOIN {{cells}} c ON s.part = c.part
        )
        SELECT * FROM steps WHERE step > 0
        """,
        cells=cells,
    )


def audit(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all filters and step. rows: part, mask, good, toxic."""
    spark = rows.sparkSession
    path = scratch_path(spark, "mask-cells")
    mask_cells(rows).write.parquet(path)
    steps = prefix_steps(spark.read.parquet(path), letters)
    # The orders are a fixed list: the factorial of the number of filters.
    orders = ["".join(p) for p in permutations(letters)]
    each = spark.createDataFrame([(o, o[: k + 1]) for o in orders for k in range(len(o))], "filter_order string, prefix string")
    # A prefix stands for as many orders as its unused letters have.
    shares = F.element_at(F.array(*[F.lit(factorial(len(letters) - k - 1)) for k in range(len(letters))]), F.col("step"))
    weighed = steps.withColumn("shapley", F.sum(F.col("removed") * shares).over(Window.partitionBy("part", "filter")))
    return weighed.join(F.broadcast(each), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_report(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five text filters in all 120 orders, counted for each part of `docs`."""
    return audit(judged(docs, labels, **columns))
