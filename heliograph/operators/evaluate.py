"""Ranking and detection measures. ranked: (group, object_idx, score, relevant 0/1).

Ranks are running counts over slices of a group (see `slices`), so a group may
hold most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import running


def ranks(ranked: DataFrame) -> DataFrame:
    """rank, hits so far and misses so far, by score and then index."""
    one = F.lit(1).cast("long")
    return running(ranked, "score", {"rank": one, "tp": F.col("relevant").cast("long"), "fp": one - F.col("relevant")}, ("object_idx",), descending=True).drop("rank_all", "fp_all")


def average_precision(ranked: DataFrame) -> DataFrame:
    return ranks(ranked).groupBy("group").agg((F.sum(F.when(F.col("relevant") == 1, F.col("tp") / F.col("rank")).otherwise(0.0)) / F.sum("relevant")).alias("average_precision"))


def inferred_average_precision(ranked: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Average precision from judgements of some rows; relevant is null where a row was not judged.

    At a relevant row of rank k the precision is expected to be 1/k, and (k-1)/k
    times the share of relevant rows among the judged ones before it.
    """
    rows = ranked.withColumns({"hit": F.coalesce("relevant", F.lit(0)).cast("long"), "judged": F.col("relevant").isNotNull().cast("long")})
    one = F.lit(1).cast("long")
    r = running(rows, "score", {"rank": one, "tp": F.col("hit"), "seen": F.col("judged")}, ("object_idx",), descending=True)
    k = F.col("rank").cast("double")
    share = (F.col("tp") - 1 + epsilon) / (F.col("seen") - 1 + 2 * epsilon)
    value = 1 / k + (k - 1) / k * F.when(k > 1, (F.col("seen") - 1) / (k - 1) * share).otherwise(0.0)
    return r.groupBy("group").agg((F.sum(F.when(F.col("hit") == 1, value)) / F.sum("hit")).alias("inferred_average_precision"))


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    top = ranks(ranked).where(F.col("rank") <= k)
    return top.groupBy("group").agg((F.sum("relevant") / F.lit(float(k))).alias("precision"), (F.sum("relevant") / F.max("tp_all")).alias("recall"))


def mean_inverse_rank(ranked: DataFrame) -> DataFrame:
    return ranks(ranked).where("relevant = 1").groupBy("group").agg(F.avg(1 / F.col("rank")).alias("mean_inverse_rank"))


def first_hit(ranked: DataFrame) -> DataFrame:
    """group, first (the best relevant row's rank), advantage over random order."""
    g = ranks(ranked).groupBy("group").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum("relevant").alias("p"), F.count("*").alias("n"))
    return g.select("group", "first", ((F.col("p") + 1) * F.col("first") / (F.col("n") + 1)).alias("advantage"))


def _steps(ranked: DataFrame) -> DataFrame:
    """One row a score: p and n of it, and tp, fp from the best score on. Equal scores are one step."""
    steps = ranked.groupBy("group", "score").agg(F.sum("relevant").alias("p"), F.sum(1 - F.col("relevant")).alias("n"))
    return running(steps, "score", {"tp": F.col("p"), "fp": F.col("n")}, descending=True)


def roc(ranked: DataFrame) -> DataFrame:
    """group, auc, eer; the area is that of the trapezoids."""
    steps = _steps(ranked)
    area = F.col("n") * (2 * F.col("tp") - F.col("p")) / 2.0
    miss, false = 1 - F.col("tp") / F.col("tp_all"), F.col("fp") / F.col("fp_all")
    return steps.groupBy("group").agg((F.sum(area) / F.max("tp_all") / F.max("fp_all")).alias("auc"), F.min_by((miss + false) / 2, F.struct(F.abs(miss - false), -F.col("score"))).alias("eer"))


def best_threshold(ranked: DataFrame, how: str = "f", count: int = 0) -> DataFrame:
    """group, threshold and the measure it reaches.

    how: f (best F-measure), r0 (best tp rate minus fp rate), count (the score from
    which on `count` rows are detected at most).
    """
    steps = _steps(ranked)
    tp, fp = F.col("tp"), F.col("fp")
    if how == "count":
        return steps.where(tp + fp <= count).groupBy("group").agg(F.min("score").alias("threshold"), F.max(tp + fp).alias("count"))
    value = 2.0 * tp / (tp + fp + F.col("tp_all")) if how == "f" else tp / F.col("tp_all") - fp / F.col("fp_all")
    steps = steps.withColumn(how, value)
    return steps.groupBy("group").agg(F.max_by("score", F.struct(how, "score")).alias("threshold"), F.max(how).alias(how))


def max_precision_recall(ranked: DataFrame) -> DataFrame:
    """group, value: the greatest least of precision and recall over all ranks."""
    r = ranks(ranked)
    return r.groupBy("group").agg(F.max(F.least(F.col("tp") / F.col("rank"), F.col("tp") / F.col("tp_all"))).alias("value"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs: (source, destination); a null destination is a rejection and is kept."""
    return pairs.groupBy("source", "destination").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    hit, rejected = F.count_if(F.col("source") == F.col("destination")), F.count_if(F.col("destination").isNull())
    return pairs.agg(hit.alias("correct"), rejected.alias("rejected"), (F.count("*") - hit - rejected).alias("erroneous"), (hit / F.count("*")).alias("accuracy"))


def cdf(values: DataFrame) -> DataFrame:
    """values (group, value) with the share of the group that is strictly below."""
    steps = values.groupBy("group", "value").agg(F.count("*").alias("own"))
    steps = running(steps, "value", {"upto": F.col("own")})
    steps = steps.select("group", "value", ((F.col("upto") - F.col("own")) / F.col("upto_all")).alias("cdf"))
    j = values.alias("v").join(steps.alias("s"), F.col("v.group").eqNullSafe(F.col("s.group")) & F.col("v.value").eqNullSafe(F.col("s.value")))
    return j.select("v.*", "s.cdf")


def harmonic(a: Column, b: Column, weight: float = 0.5) -> Column:
    """Weighted harmonic mean, 0 if either is 0."""
    return F.when((a == 0) | (b == 0), 0.0).otherwise(1 / (weight / a + (1 - weight) / b))


def bleu(candidates: DataFrame, references: DataFrame, n: int = 4) -> DataFrame:
    """candidates, references: (id, words). id, bleu: the geometric mean of clipped n-gram precisions of 1 to n words,
    times the brevity penalty; 0 where an order has no match or no n-gram."""

    def order(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: i <= F.size("words") - (k - 1))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.array_join(F.slice("words", i, k), " ").alias("g")))

    def grams(df: DataFrame) -> DataFrame:
        made = [order(k) for k in range(1, n + 1)]
        return df.select("id", F.explode(F.concat(*made)).alias("x")).groupBy("id", "x.k", "x.g").agg(F.count("*").alias("n"))

    c, r = grams(candidates), grams(references).withColumnRenamed("n", "m")
    p = c.join(r, ["id", "k", "g"], "left").groupBy("id", "k").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("p"))
    p = p.groupBy("id").agg(F.when((F.count("*") == n) & (F.min("p") > 0), F.exp(F.sum(F.log(F.when(F.col("p") > 0, F.col("p")))) / n)).otherwise(0.0).alias("p"))
    size = lambda df, name: df.select("id", F.size("words").alias(name))
    j = p.join(size(candidates, "c"), "id").join(size(references, "r"), "id")
    return j.select("id", (F.col("p") * F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))).alias("bleu"))
