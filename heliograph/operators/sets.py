"""Ternary object sets: object_idx, v in {-1, 0, 1}; an absent row is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(value: Column) -> Column:
    """The mean of doubles by their exact decimal sum, for thresholds: the same in any order of the rows.

    Where a value or the sum is beyond 20 digits before the point, or not a number, it is avg.
    """
    exact = value.try_cast("decimal(38,18)")
    n = F.count(value)
    return F.coalesce(F.when(F.count(exact) == n, F.try_sum(exact).cast("double") / F.nullif(n, F.lit(0))), F.avg(value))


def t_and(x: Column, y: Column) -> Column:
    return F.least(x, y)


def t_or(x: Column, y: Column) -> Column:
    """Greatest if either is positive, else least: -1 wins over 0."""
    return F.when((x > 0) | (y > 0), F.greatest(x, y)).otherwise(F.least(x, y))


def t_or_max(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def t_minus(x: Column, y: Column) -> Column:
    return t_and(x, -y)


def t_xor(x: Column, y: Column) -> Column:
    return t_or(t_minus(x, y), t_minus(y, x))


def t_mask(x: Column, y: Column) -> Column:
    return F.when(y > 0, x).otherwise(F.lit(0))


OPERATORS = {"and": t_and, "or": t_or, "ormax": t_or_max, "minus": t_minus, "xor": t_xor, "mask": t_mask}


def combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """A full outer join on object_idx; both sides hash on it once."""
    both = left.select("object_idx", F.col("v").alias("a")).join(right.select("object_idx", F.col("v").alias("b")), "object_idx", "full")
    both = both.select("object_idx", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.select("object_idx", OPERATORS[op](F.col("a"), F.col("b")).cast("int").alias("v"))


def wide(sets: DataFrame, names: list[str]) -> DataFrame:
    """sets: (name, object_idx, v) as one column per name, by one shuffle whatever the number of sets."""
    return sets.where(F.col("name").isin(names)).groupBy("object_idx").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("v"))), F.lit(0)).alias(n) for n in names])


def negate(s: DataFrame) -> DataFrame:
    return s.withColumn("v", -F.col("v"))


def exclusive(s: DataFrame, universe: DataFrame) -> DataFrame:
    """0 becomes -1."""
    return universe.select("object_idx").join(s, "object_idx", "left").select("object_idx", F.when(F.coalesce("v", F.lit(0)) == 0, -1).otherwise(F.col("v")).alias("v"))


def defined(s: DataFrame) -> DataFrame:
    """-1 becomes 1."""
    return s.withColumn("v", F.when(F.col("v") == -1, 1).otherwise(F.col("v")))


def counts(s: DataFrame) -> DataFrame:
    return s.agg(*[F.count_if(F.col("v") == k).alias(n) for k, n in ((-1, "minus"), (0, "zero"), (1, "plus"))])


def members(s: DataFrame, v: int = 1) -> DataFrame:
    return s.where(F.col("v") == v).select("object_idx")


def seeded(s: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n members in the order of a hash of seed and index: exact in number, the same on every run."""
    return s.withColumn("h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("object_idx").cast("string")).cast("binary"))).orderBy("h", "object_idx").limit(n).drop("h")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
