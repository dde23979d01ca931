"""Parents, children and the flow of relevance between them. edges: (parent_idx, child_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..runtime import staged, unstage


def children(objects: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(objects.select(F.col("object_idx").alias("parent_idx")), "parent_idx", "left_semi").select(F.col("child_idx").alias("object_idx")).distinct()


def parents(objects: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(objects.select(F.col("object_idx").alias("child_idx")), "child_idx", "left_semi").select(F.col("parent_idx").alias("object_idx")).distinct()


def siblings(edges: DataFrame) -> DataFrame:
    """child_idx, n: how many other children its parents have; counted, so no pairs are made."""
    n = F.count("*").over(W.partitionBy("parent_idx")) - 1
    return edges.select("child_idx", n.alias("n")).groupBy("child_idx").agg(F.sum("n").alias("n"))


def roots(edges: DataFrame) -> DataFrame:
    """child_idx, root_idx: pointers double their reach in each round, until none moves. On a cycle, which has
    no root, pointers stop after as many rounds as a chain of all its objects could need."""
    up = staged(edges.select(F.col("child_idx").alias("c"), F.col("parent_idx").alias("p")), "roots")
    for _ in range(max(1, up.count().bit_length())):
        far = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        new = staged(up.join(far, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "roots")
        unstage(up)
        up = new
        if up.where("moved").isEmpty():
            break
    return up.select(F.col("c").alias("child_idx"), F.col("p").alias("root_idx")).distinct()


def relevance_up(scores: DataFrame, edges: DataFrame, how: str = "sum") -> DataFrame:
    """scores (object_idx, value) to parents: sum, max, or avg (the sum over the number of all children)."""
    s = edges.join(scores.withColumnRenamed("object_idx", "child_idx"), "child_idx", "left")
    agg = {"sum": F.sum("value"), "max": F.max("value"), "avg": F.sum("value") / F.count("*")}[how]
    return s.groupBy(F.col("parent_idx").alias("object_idx")).agg(agg.alias("value")).where("value is not null")


def relevance_down(scores: DataFrame, edges: DataFrame, divide: bool = True, factor: float = 1.0) -> DataFrame:
    e = edges.withColumn("n", F.count("*").over(W.partitionBy("parent_idx"))) if divide else edges.withColumn("n", F.lit(1))
    s = e.join(scores.withColumnRenamed("object_idx", "parent_idx"), "parent_idx")
    return s.groupBy(F.col("child_idx").alias("object_idx")).agg(F.sum(F.lit(factor) * F.col("value") / F.col("n")).alias("value"))


def combine_parts(scores: DataFrame, edges: DataFrame, how: str, own: DataFrame | None = None) -> DataFrame:
    """An object's score from its parts': sum, max, sqrsum (root of the squares of the positive ones),
    sublinear (each divided by its rank among them), mul (product of 1 + the positive ones, less 1) or zero (none).
    own (object_idx, value): the objects' scores of their own, which are added."""
    s = edges.join(scores.withColumnRenamed("object_idx", "child_idx"), "child_idx")
    if how == "sublinear":
        s = s.withColumn("value", F.col("value") / F.row_number().over(W.partitionBy("parent_idx").orderBy(F.desc("value"), "child_idx")))
    positive = F.greatest("value", F.lit(0.0))
    agg = {"sum": F.sum("value"), "max": F.max("value"), "sqrsum": F.sqrt(F.sum(positive * positive)), "sublinear": F.sum("value"), "mul": F.exp(F.sum(F.log1p(positive))) - 1, "zero": F.lit(0.0)}[how]
    parts = s.groupBy(F.col("parent_idx").alias("object_idx")).agg(agg.alias("value"))
    return parts if own is None else parts.unionByName(own.select("object_idx", "value")).groupBy("object_idx").agg(F.sum("value").alias("value"))


def expand(scores: DataFrame, edges: DataFrame, plan: str, how: str = "sum", divide: bool = True) -> DataFrame:
    """Relevance through the hierarchy: `up`, `down`, `updown` or `downup`, or `none`; each step adds to what objects have."""
    steps = {"none": [], "up": ["up"], "down": ["down"], "updown": ["up", "down"], "downup": ["down", "up"]}[plan]
    for step in steps:
        moved = relevance_up(scores, edges, how) if step == "up" else relevance_down(scores, edges, divide)
        scores = scores.select("object_idx", "value").unionByName(moved).groupBy("object_idx").agg(F.sum("value").alias("value"))
    return scores
