"""Relations between concepts. edges: (first, second)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged, unstage


def closure(edges: DataFrame) -> DataFrame:
    """All (first, second) that a chain of edges joins. Paths double in length each round and pairs are kept
    once, so cycles end it like anything else."""
    known = staged(edges.select("first", "second").distinct(), "closure")
    n = known.count()
    while True:
        far = known.alias("a").join(known.alias("b"), F.col("a.second") == F.col("b.first")).select("a.first", "b.second")
        new = staged(known.unionByName(far).distinct(), "closure")
        unstage(known)
        known, before, n = new, n, new.count()
        if n == before:
            return known


def expand(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (concept, object_idx) with those of all narrower concepts: edges lead from the narrower to the wider one."""
    wider = members.join(closure(edges).withColumnRenamed("first", "concept"), "concept").select(F.col("second").alias("concept"), "object_idx")
    return members.select("concept", "object_idx").unionByName(wider).distinct()
