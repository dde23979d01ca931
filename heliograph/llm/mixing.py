"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source gets `weight / sum of weights` of all words, but no more than
`max_epochs` times its own; what lies above is reshared by weight among the
sources below their caps. The fixed point is target = min(cap, level * weight),
with the level found by one ordered scan over the table of sources, so there is
no loop. Documents are then repeated: whole epochs for all, and the fraction
that is left for the documents that come first by a seeded hash.

Defined results: a null text has size 0; a null source is a source, the last;
rows with the same id (null too) are decided together; an empty table gives an
empty result; a table without a source is one source; columns of the input named like
those made here are untouched, as only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..runtime import staged, table
from .text import columns, fresh, n_words, own, value

MAX_EPOCHS = 3
SEED = "mix-1-"


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, over the sources in code-point order."""
    return (rank - 1) % 3 + 1


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weight=cyclic_weight) -> DataFrame:
    """source, source_size, weight, target.

    The unpartitioned windows run over one row per source, after the sizes
    have been summed map-side; documents never meet in one task.
    """
    by = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    by = by.withColumn("weight", weight(F.row_number().over(W.orderBy(*order))).cast("double"))
    cap = (max_epochs * F.col("source_size")).cast("double")
    every = W.partitionBy()
    # How far a source can follow a rising level before it is full.
    filled = W.orderBy(F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf"))), *order)
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    by = by.withColumns({"cap": cap, "total": F.sum(F.col("source_size").cast("double")).over(every), "weights": F.sum("weight").over(every)})
    by = by.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), zero), "weight_before": F.coalesce(F.sum("weight").over(before), zero)})
    by = by.withColumn("full", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("weights") - F.col("weight_before")))
    full = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(every)
    level = F.try_divide(F.col("total") - full("cap"), F.col("weights") - full("weight"))
    return by.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weight=cyclic_weight) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix holds each document.

    The documents of a source are spread over 4096 hash buckets. Sums by bucket
    say where the fraction ends, so an ordered scan only ever covers one bucket
    of one source, however much of the table that source holds.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    docs = columns(docs, doc_id="long", source="string", text="string")
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "mix-sizes").withColumn("bucket", F.substring("key", 1, 3))
    aim = targets(sizes, max_epochs, weight)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aim = aim.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    b = buckets.alias("b").join(aim.alias("a"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.source", "b.bucket", "ahead", "source_size", "target", "whole", "rest")
    inside = W.partitionBy("source", "bucket").orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    tied = W.partitionBy("source", "bucket", "key")
    sizes = sizes.withColumns({"upto": F.sum("size").over(inside), "tie": F.sum("size").over(tied)})
    out = sizes.alias("s").join(b.alias("b"), (F.col("s.source").eqNullSafe(F.col("b.source"))) & (F.col("s.bucket") == F.col("b.bucket")))
    extra = (F.col("ahead") + F.col("upto") - F.col("tie") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)
    return out.select("doc_id", "s.source", "key", "size", "source_size", "target", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weight=cyclic_weight) -> DataFrame:
    """The rows of docs, each as often as the mix holds it; same columns.

    Decisions hang on (doc_id, source) alone, so rows that share both share
    theirs, and the join needs one decision a pair.
    """
    key, source, times = fresh(docs, "_mix_id", "_mix_source", "_mix_copies")
    d = copies(docs, max_epochs, seed, weight).groupBy("doc_id", "source").agg(F.max("copies").alias("copies"))
    d = d.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("copies").alias(times))
    took = docs.join(d.hint("merge"), value(docs, "doc_id", "long").eqNullSafe(d[key]) & value(docs, "source", "string").eqNullSafe(d[source]))
    took = took.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return took.select(*own(docs))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight,
             ({MAX_EPOCHS} * source_size)::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS total FROM s),
c AS (SELECT *, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) * weight >= cap * (weights - weight_before) AS is_full FROM c),
l AS (SELECT *, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
               / nullif(weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (), 0) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE level * weight END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM e),
k AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY source, key) AS tie FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
       (k.size * (r.whole + CASE WHEN r.rest > 0 AND k.upto - k.tie / 2.0 <= r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
