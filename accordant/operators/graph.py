"""Connected components over shared keys, and over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from accordant.session import checkpoint, delete_path, merge_join, scratch_path


def connect(memberships: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """(node, root): nodes that share a key, directly or through others, get the same smallest node.

    Labels flow node -> key -> node as minima, which combine before the shuffle, so a key held by
    a third of all nodes costs one number per task. Each round also follows the label's own label,
    which halves long chains. Rounds are checkpointed and end when nothing moved.
    """
    pairs = checkpoint(memberships.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct())
    labels = checkpoint(pairs.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        keyed = merge_join(pairs, labels, ["node"], "inner").groupBy("key").agg(F.min("root").alias("root"))
        seen = merge_join(pairs, keyed, ["key"], "inner").groupBy("node").agg(F.min("root").alias("root"))
        jump = seen.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = merge_join(seen, jump, ["root"]).select("node", F.coalesce("further", "root").alias("next"))
        step = checkpoint(
            labels.join(moved.hint("merge"), "node", "left").select(
                "node",
                F.least("root", "next").alias("root"),
                (F.col("next") < F.col("root")).alias("moved"),
            )
        )
        labels = step.select("node", "root")
        if not step.filter("moved").take(1):
            return labels


def contract(edges: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(node, root): the nodes of the edges with the smallest node of their component.

    Rounds of large stars and small stars: every node points what is larger than it, then what is smaller, at the
    smallest node it knows. Known minima are aggregates that combine before the shuffle, so a node with a third of all
    edges costs a line a task. A component that has become a star is written out and leaves the working set; a
    round's table is deleted when the next one is written. A chain of n nodes takes about log2(n) rounds. No join
    broadcasts: a broadcast passes through the driver, and the rounds together have many.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    live = edges.filter(a != b).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    paths: list[str] = []
    schema = StructType([*live.schema.fields, StructField("finished", BooleanType())])
    while True:
        path = scratch_path(spark, "stars")
        _marked(_small_star(_large_star(live))).write.partitionBy("finished").parquet(path)
        if paths:
            delete_path(spark, f"{paths[-1]}/finished=false")
        paths.append(path)
        table = spark.read.schema(schema).parquet(path)
        live = table.filter("not finished").drop("finished")
        if not live.take(1):
            break
    done = [spark.read.schema(schema).parquet(p).filter("finished") for p in paths]
    stars = done[0]
    for more in done[1:]:
        stars = stars.unionByName(more)
    ends = F.array(F.struct(F.col("child").alias("node"), F.col("parent").alias("root")), F.struct(F.col("parent").alias("node"), F.col("parent").alias("root")))
    return stars.select(F.inline(ends)).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points at the smallest of the node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct(F.col("child").alias("node"), F.col("parent").alias("other")), F.struct(F.col("parent").alias("node"), F.col("child").alias("other")))))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return merge_join(both.filter("other > node"), least, ["node"], "inner").select(F.col("other").alias("child"), F.col("least").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of them."""
    least = edges.groupBy("child").agg(F.min("parent").alias("least"))
    joined = merge_join(edges, least, ["child"], "inner")
    both = F.array(F.struct("child", F.col("least").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")))
    return joined.select(F.inline(both)).filter("child <> parent").distinct()


def _marked(edges: DataFrame) -> DataFrame:
    """Add `finished`: the component is a star, so its centre has no parent and its children no other edge."""
    ends = F.array(F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    known = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    child = merge_join(edges, known.withColumnRenamed("node", "child"), ["child"], "inner")
    open_child = child.select("child", "parent", ((F.col("up") > 1) | (F.col("down") > 0)).alias("open"))
    centres = open_child.select(F.col("parent").alias("node"), "open").unionByName(known.filter("up > 0").select("node", F.lit(True).alias("open")))
    state = centres.groupBy("node").agg(F.max("open").alias("open")).withColumnRenamed("node", "parent")
    return merge_join(edges, state, ["parent"], "inner").select("child", "parent", (~F.col("open")).alias("finished"))
