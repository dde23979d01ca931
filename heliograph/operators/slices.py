"""Running sums within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..runtime import staged


def running(rows: DataFrame, value: str, sums: dict[str, Column], ties: tuple[str, ...] = (), descending: bool = False, slices: int = 64) -> DataFrame:
    """rows (group, value, ..) with, for each name of sums, the sum over the group's rows up to this one in the
    order of value and ties, and the sum over the whole group as `name_all`.

    Each group is cut into slices at its approximate quantiles. Sums by slice (a
    few rows a group) say what lies before each, and only the rows of one slice
    are sorted together; so a group that holds most of the table is split.
    """
    rows = staged(rows.withColumns(sums), "slices")
    cuts = rows.groupBy("group").agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), [k / slices for k in range(1, slices)], 1000)).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    cut = rows.alias("r").join(cuts.alias("c"), F.col("r.group").eqNullSafe(F.col("c.group"))).select("r.*", F.coalesce(-below if descending else below, F.lit(0)).alias("_slice"))
    by = cut.groupBy("group", "_slice").agg(*[F.sum(n).alias(f"_in_{n}") for n in sums])
    group = W.partitionBy("group")
    ahead = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    by = by.select("group", "_slice", *[F.coalesce(F.sum(f"_in_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in sums], *[F.sum(f"_in_{n}").over(group).alias(f"{n}_all") for n in sums])
    inside = W.partitionBy("group", "_slice").orderBy(F.desc(value) if descending else F.col(value), *ties).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(n).over(inside) for n in sums})
    out = out.alias("o").join(by.alias("b"), F.col("o.group").eqNullSafe(F.col("b.group")) & (F.col("o._slice") == F.col("b._slice")))
    return out.select("o.*", *[f"b._ahead_{n}" for n in sums], *[f"b.{n}_all" for n in sums]).withColumns({n: F.col(n) + F.col(f"_ahead_{n}") for n in sums}).drop("_slice", *[f"_ahead_{n}" for n in sums])
