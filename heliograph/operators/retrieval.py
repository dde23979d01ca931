"""One round of relevance feedback over maps of units.

bmu: (feature, object_idx, x, y), where every object lies on a map of width x height.
seen: (object_idx, value), positive or negative relevance. The stages are
DataFrame steps: place hits on units, convolve, rank units, take their objects,
merge features, select.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import kernel


def place(seen: DataFrame, bmu: DataFrame) -> DataFrame:
    """feature, x, y, hits: positives weigh 1/P in all, negatives -1/N, over objects that are on the map."""
    s = seen.join(bmu, "object_idx")
    w = W.partitionBy("feature")
    pos, neg = F.greatest("value", F.lit(0.0)), F.greatest(-F.col("value"), F.lit(0.0))
    s = s.withColumns({"P": F.sum(pos).over(w), "N": F.sum(neg).over(w)})
    value = F.coalesce(F.try_divide(pos, F.col("P")), F.lit(0.0)) - F.coalesce(F.try_divide(neg, F.col("N")), F.lit(0.0))
    return s.withColumn("h", value).groupBy("feature", "x", "y").agg(F.sum("h").alias("hits"))


def convolve(hits: DataFrame, width: int, height: int, name: str = "triangle", radius: int = 2, parameter: float = 1.0) -> DataFrame:
    """feature, x, y, value on every unit that a hit reaches.

    A separable kernel in two passes; each pass divides by the kernel's mass inside
    the map. A hit is sent to its neighbours (2 radius + 1 rows), so there is no join.
    """
    w = kernel(name, radius, parameter)
    weight = F.array(*[F.lit(w[abs(d)]) for d in range(-radius, radius + 1)])

    def along(df: DataFrame, axis: str, size: int, other: str, value: str) -> DataFrame:
        d = df.select("feature", other, F.col(axis).alias("at"), value, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
        d = d.withColumn(axis, F.col("at") + F.col("d")).where(F.col(axis).between(0, size - 1))
        mass = F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda a, k: a + F.when((F.col(axis) + k).between(0, size - 1), F.get(weight, k + radius)).otherwise(0.0))
        summed = d.groupBy("feature", axis, other).agg(F.sum(F.col(value) * F.get(weight, F.col("d") + radius)).alias("sum"))
        return summed.select("feature", axis, other, (F.col("sum") / mass).alias("value"))

    return along(along(hits, "x", width, "y", "hits"), "y", height, "x", "value").select("feature", "x", "y", "value")


def map_weights(maps: DataFrame, units: int) -> DataFrame:
    """feature, weight: (1 - H / H max) of the positive part of each map, and 0 for the flattest."""
    p = F.col("value") / F.sum("value").over(W.partitionBy("feature"))
    h = maps.where("value > 0").withColumn("p", p).groupBy("feature").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(float(units)))).alias("h"))
    return h.select("feature", F.greatest(F.lit(0.0), 1 - F.col("h")).alias("weight"))


def best_units(maps: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("value"), "x", "y"))
    return maps.withColumn("rank", rank).where(F.col("rank") <= n)


def score_objects(maps: DataFrame, bmu: DataFrame, seen: DataFrame, n: int, weights: DataFrame | None = None) -> DataFrame:
    """object_idx, value: the n best unseen objects by the sum of their units' values over features."""
    s = bmu.join(maps, ["feature", "x", "y"])
    if weights is not None:
        s = s.join(weights, "feature").withColumn("value", F.col("value") * F.col("weight"))
    s = s.join(seen.select("object_idx"), "object_idx", "left_anti").groupBy("object_idx").agg(F.sum("value").alias("value"))
    return s.orderBy(F.desc(F.round("value", 9)), "object_idx").limit(n)


def relativize(scores: DataFrame) -> DataFrame:
    """Divided by the greatest one, where that is positive."""
    m = F.max("value").over(W.partitionBy())
    return scores.withColumn("value", F.when(m > 0, F.col("value") / m).otherwise(F.col("value")))
