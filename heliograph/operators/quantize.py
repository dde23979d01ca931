"""Histograms, scalar and vector quantisers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..runtime import staged


def histogram(values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Right-closed bins over (low, high]: bin, n, cumulative. What lies outside goes to the first and last."""
    width = (high - low) / bins
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("value") - low) / width))).cast("int")
    h = values.where("value is not null").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("cumulative", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def equal_frequency(values: DataFrame, parts: int, slices: int = 64) -> DataFrame:
    """value, part: parts of equal numbers; equal values share the part of the first of them.

    Values are cut into slices at approximate quantiles; sums by slice (a few
    rows) say how many values lie before each, and the running count within a
    slice is exact, so no task sorts all distinct values.
    """
    distinct = values.groupBy("value").agg(F.count("*").alias("n"))
    cuts = values.agg(F.percentile_approx("value", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    distinct = staged(distinct.withColumn("slice", at), "equal-frequency")
    sums = distinct.groupBy("slice").agg(F.sum("n").alias("in_slice"))
    ahead = F.coalesce(F.sum("in_slice").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("slice", ahead.alias("ahead"), F.sum("in_slice").over(W.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("slice").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = distinct.withColumn("inside", inside).join(sums, "slice")
    d = d.select("value", F.floor((F.col("ahead") + F.col("inside")) * parts / F.col("total")).cast("int").alias("part"))
    return values.join(d, "value")


def entropy(symbols: DataFrame, base: float = 2.0) -> DataFrame:
    n = symbols.groupBy("group", "symbol").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("group"))
    return n.withColumn("p", p).groupBy("group").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(base))).alias("entropy"))


def means(features: DataFrame, key: str) -> DataFrame:
    """The mean vector of each key. Components are summed map-side, by place."""
    p = features.select(key, F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def unit_sums(features: DataFrame, centres: np.ndarray) -> np.ndarray:
    """[unit, 2 + components]: how many objects are nearest to each centre, the sum of their distances and of their vectors.

    A task holds one row a unit, whatever the number of objects; nothing else is shuffled.
    """
    sent = features.sparkSession.sparkContext.broadcast(centres)
    units, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, acc = sent.value, np.zeros((units, dim + 2))
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                x = np.array(b.column(0).slice(s, 1024).to_pylist(), float)
                d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ m.T + (m * m).sum(1), 0)
                u = np.round(d, 9).argmin(1)
                np.add.at(acc, u, np.column_stack([np.ones(len(x)), d[np.arange(len(x)), u], x]))
        yield pa.RecordBatch.from_arrays([pa.array(range(units), pa.int32()), pa.array(acc.tolist(), pa.list_(pa.float64()))], ["unit", "acc"])

    got = features.where("vec is not null").select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "unit int, acc array<double>")
    acc = np.zeros((units, dim + 2))
    for r in got.groupBy("unit").agg(F.array(*[F.sum(F.col("acc")[j]) for j in range(dim + 2)]).alias("acc")).collect():
        acc[r["unit"]] = r["acc"]
    return acc


def _start(features: DataFrame, k: int) -> np.ndarray:
    rows = features.where("vec is not null").orderBy(F.md5(F.concat(F.lit("kmeans-0-"), F.col("object_idx").cast("string")).cast("binary"))).limit(k).orderBy("object_idx").collect()
    return np.array([r["vec"] for r in rows], float)


def kmeans(features: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """unit, vec by Lloyd's method from a seeded start; every round is one pass that ends in one row a unit.
    Empty units keep their place."""
    centres = _start(features, k)
    for _ in range(rounds):
        acc = unit_sums(features, centres)
        new = np.where(acc[:, :1] > 0, acc[:, 2:] / np.maximum(acc[:, :1], 1), centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-9:
            break
    return centres_frame(features, centres)


def lbg(features: DataFrame, k: int, rounds: int = 6, shift: float = 1e-3) -> DataFrame:
    """unit, vec by splitting: all centres are doubled, shifted apart, and moved by Lloyd's rounds, until there are k.
    An empty cell takes the mean of the fullest one, shifted."""
    acc = unit_sums(features, _start(features, 1))
    centres = acc[:, 2:] / np.maximum(acc[:, :1], 1)
    while True:
        for _ in range(rounds):
            acc = unit_sums(features, centres)
            full = acc[:, 0].argmax()
            new = np.where(acc[:, :1] > 0, acc[:, 2:] / np.maximum(acc[:, :1], 1), acc[full, 2:] / max(1, acc[full, 0]) + shift)
            moved, centres = np.abs(new - centres).max(), new
            if moved < 1e-9:
                break
        if len(centres) >= k:
            return centres_frame(features, centres)
        centres = np.concatenate([centres - shift, centres + shift])[: max(k, len(centres) + 1)]


def centres_frame(features: DataFrame, centres: np.ndarray) -> DataFrame:
    return features.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "unit long, vec array<double>")


def decode_products(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """codes (object_idx, codes) with a codebook (sub, code, part) to (object_idx, vec)."""
    x = codes.select("object_idx", F.posexplode("codes").alias("sub", "code")).join(codebook, ["sub", "code"])
    return x.groupBy("object_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sub", "part"))), lambda s: s["part"])).alias("vec"))
