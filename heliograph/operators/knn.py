"""Exact nearest neighbours of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Queries that go out together; more of them go out in further blocks.
QUERY_BLOCK = 2048
_ROWS = 1024


def _distances(metric: str, x: np.ndarray, q: np.ndarray, p: float) -> np.ndarray:
    """(queries, rows). Inner products by matrix products; the others component by component."""
    if metric in ("euclidean", "cosine"):
        d = q @ x.T
        if metric == "euclidean":
            return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * d, 0)
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return 1 - np.divide(d, n, out=np.zeros_like(d), where=n > 0)
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        a, b = q[:, j][:, None], x[:, j][None]
        if metric == "maximum":
            np.maximum(out, (a - b) ** 2, out=out)
        elif metric == "manhattan":
            out += np.abs(a - b)
        elif metric == "ell":
            out += np.abs(a - b) ** p
        elif metric == "chisquare":
            out += np.divide((a - b) ** 2, a + b, out=np.zeros_like(out), where=(a + b) != 0)
        elif metric == "histogram_intersection":
            out -= np.minimum(a, b)
        else:
            raise ValueError(f"no metric is named {metric}")
    return out ** (2 / p) if metric == "ell" else out


def knn_join(features: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", p: float = 3.0, exclude_self: bool = True) -> DataFrame:
    """features, queries: (object_idx, vec). query_idx, object_idx, rank, distance.

    Rows are never shuffled: each batch keeps k rows a query and only those meet
    in the window. The driver holds the ids of the stated queries, and their
    vectors a block at a time. Rows without an id or a vector are left out; queries
    that share an id are one, with the least of their vectors. Similarities
    (histogram_intersection) are negated, so the least is the nearest everywhere.
    """
    spark = features.sparkSession
    features = features.where("object_idx is not null and vec is not null")
    queries = queries.where("object_idx is not null and vec is not null").groupBy("object_idx").agg(F.min("vec").alias("vec"))
    ids = queries.select(F.col("object_idx").alias("q")).orderBy("q").toArrow().column("q").to_numpy()
    found = []
    for at in range(0, max(1, len(ids)), QUERY_BLOCK):
        part = ids[at : at + QUERY_BLOCK]
        own = queries.where(F.col("object_idx").between(int(part[0]), int(part[-1]))).select("object_idx", F.col("vec").cast("array<double>").alias("vec")).orderBy("object_idx").toArrow() if len(part) else None
        q = np.array(own.column("vec").to_pylist()) if own is not None else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((part, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            for batch in batches:
                for s in range(0, batch.num_rows, _ROWS):
                    b = batch.slice(s, _ROWS)
                    i, x = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), float)
                    if not len(i) or not len(qid):
                        continue
                    d = np.round(_distances(metric, x, q, p), 9)
                    if exclude_self:
                        d[qid[:, None] == i] = np.inf
                    n = min(k, len(i))
                    least = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                    r, c = np.nonzero((d <= least) & np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(i[c]), pa.array(d[r, c])], ["query_idx", "object_idx", "distance"])

        found.append(features.select("object_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "query_idx long, object_idx long, distance double"))
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    rank = F.row_number().over(W.partitionBy("query_idx").orderBy("distance", "object_idx"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_idx", "object_idx", F.col("rank").cast("int").alias("rank"), "distance")


def vote(neighbours: DataFrame, labels: DataFrame, reject: int = 0) -> DataFrame:
    """The majority label of each query's neighbours. On a tie the farthest is dropped until it is
    broken; label is null where the winner has fewer than `reject` votes."""
    n = neighbours.join(labels.select("object_idx", "label"), "object_idx").select("query_idx", "rank", "label")
    most = n.agg(F.max("rank")).first()[0] or 0
    # votes of every label among the nearest 1, 2, .. of a query
    upto = n.withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(int(most))))).groupBy("query_idx", "k", "label").agg(F.count("*").alias("votes"))
    top = W.partitionBy("query_idx", "k")
    upto = upto.withColumn("best", F.max("votes").over(top)).where("votes = best").withColumn("winners", F.count("*").over(top)).where("winners = 1")
    won = upto.groupBy("query_idx").agg(F.max_by(F.struct("label", "votes"), "k").alias("w"))
    return won.select("query_idx", F.when(F.col("w.votes") >= reject, F.col("w.label")).alias("label"), F.col("w.votes").alias("votes"))


def assign(features: DataFrame, centres: DataFrame, metric: str = "euclidean", p: float = 3.0) -> DataFrame:
    """object_idx, unit, distance: the nearest of the centres (unit, vec) of each object, ties to the least unit.

    A codebook is a model of fixed size; it is broadcast as a matrix and rows stay where they are.
    """
    c = centres.select("unit", F.col("vec").cast("array<double>").alias("vec")).orderBy("unit").toArrow()
    units, m = c.column("unit").to_numpy(), np.array(c.column("vec").to_pylist())
    sent = features.sparkSession.sparkContext.broadcast((units, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, m = sent.value
        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                b = batch.slice(s, _ROWS)
                d = np.round(_distances(metric, m, np.array(b.column(1).to_pylist(), float), p), 9)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units[d.argmin(1)]), pa.array(d.min(1))], ["object_idx", "unit", "distance"])

    return features.select("object_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "object_idx long, unit long, distance double")
