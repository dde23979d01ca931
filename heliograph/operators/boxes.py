"""Boxes as columns x0, y0, x1, y1, and fusion of detection scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_area(a: str, b: str) -> Column:
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{k}1"), F.col(f"{b}.{k}1")) - F.greatest(F.col(f"{a}.{k}0"), F.col(f"{b}.{k}0")))
    return side("x") * side("y")


def area(a: str) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))


def overlap_ratio(a: str, b: str) -> Column:
    s = shared_area(a, b)
    return F.coalesce(F.try_divide(s, area(a) + area(b) - s), F.lit(0.0))


def best_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each box of left (key, id, box) with the box of right of the same key that shares the most area, ties to the least id."""
    j = left.alias("l").join(right.alias("r"), key).select(key, F.col("l.id").alias("id"), F.col("r.id").alias("other"), shared_area("l.box", "r.box").alias("shared"), overlap_ratio("l.box", "r.box").alias("ratio"))
    best = F.max_by(F.struct("other", "shared", "ratio"), F.struct("shared", -F.col("other")))
    return j.where("shared > 0").groupBy(key, "id").agg(best.alias("b")).select(key, "id", "b.other", "b.shared", "b.ratio")


def fuse(scores: list[Column], how: str) -> Column:
    """One score of several: min, max, mean, geometric (0 if any isn't positive) or harmonic mean."""
    n = float(len(scores))
    if how == "min":
        return F.least(*scores)
    if how == "max":
        return F.greatest(*scores)
    if how == "mean":
        return reduce(lambda a, b: a + b, scores) / n
    positive = reduce(lambda a, b: a & b, [s > 0 for s in scores])
    if how == "geometric":
        return F.when(positive, F.exp(reduce(lambda a, b: a + b, [F.log(F.when(positive, s)) for s in scores]) / n)).otherwise(0.0)
    if how == "harmonic":
        return F.when(positive, n / reduce(lambda a, b: a + b, [1 / F.when(positive, s) for s in scores])).otherwise(0.0)
    raise ValueError(f"no fusion is named {how}")


def smooth(detections: DataFrame, reach: int) -> DataFrame:
    """detections (parent, at, score) with the mean of `reach` neighbours on either side in time."""
    w = W.partitionBy("parent").orderBy("at").rowsBetween(-reach, reach)
    return detections.withColumn("smoothed", F.avg("score").over(w))


def valid(a: str) -> Column:
    """A box whose sides have length, and whose corners are known."""
    return F.coalesce((F.col(f"{a}.x1") > F.col(f"{a}.x0")) & (F.col(f"{a}.y1") > F.col(f"{a}.y0")), F.lit(False))
