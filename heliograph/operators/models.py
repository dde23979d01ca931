"""Small models: principal components, least squares, local subspaces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def moments_matrix(features: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the sums of products of (1, vec) with itself: one small matrix a task, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                x = np.column_stack([np.ones(len(x)), x])
                acc = x.T @ x if acc is None else acc + x.T @ x
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(acc)), pa.int32()), pa.array(acc.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    m = features.select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "i int, row array<double>")
    got = m.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = 1 + max((r["i"] for r in got), default=0)
    s = np.zeros((d, d))
    for r in got:
        s[r["i"], r["j"]] = r["x"]
    return int(s[0, 0]), s


def covariance(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (n - 1)."""
    n, s = moments_matrix(features)
    mean = s[0, 1:] / max(n, 1)
    return n, mean, (s[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal_components(features: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, the k directions of greatest variance (rows; first non-zero entry positive) and their variances."""
    _, mean, c = covariance(features)
    w, v = np.linalg.eigh(c)
    v = v[:, ::-1][:, :k].T
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return mean, v * sign[:, None], w[::-1][:k]


def project(features: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """object_idx, vec in the new coordinates, as column arithmetic."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = V.pairwise("vec", lit(mean), lambda x, y: x - y)
    return features.select("object_idx", centred.alias("c")).select("object_idx", F.array(*[V.dot("c", lit(d)) for d in directions]).alias("vec"))


def line_fit(points: DataFrame) -> DataFrame:
    """slope, intercept and correlation of y on x by group: sums only."""
    g = points.groupBy("group").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("correlation"))
    return g


def local_subspace(neighbours: DataFrame, features: DataFrame, queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """query_idx, label: the class whose k nearest members (of neighbours: query_idx, object_idx, rank) span the
    nearest affine subspace."""
    n = neighbours.join(labels, "object_idx").join(features.select("object_idx", "vec"), "object_idx")
    q = queries.select(F.col("object_idx").alias("query_idx"), F.col("vec").cast("array<double>").alias("q"))
    g = n.groupBy("query_idx", "label").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col("vec").cast("array<double>").alias("vec")))), 1, k).alias("near")).join(q, "query_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for near, q in zip(b.column("near").to_pylist(), b.column("q").to_pylist()):
                p = np.array([x["vec"] for x in near])
                centre, d = p.mean(0), np.array(q) - p.mean(0)
                u = np.linalg.svd(p - centre, full_matrices=False)[2][: max(0, len(p) - 1)]
                out.append(float(d @ d - ((u @ d) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([b.column("query_idx"), b.column("label"), pa.array(out)], ["query_idx", "label", "distance"])

    d = g.select("query_idx", "label", "near", "q").mapInArrow(run, "query_idx long, label int, distance double")
    return d.groupBy("query_idx").agg(F.min_by("label", F.struct("distance", "label")).alias("label"))


def subspaces(features: DataFrame, k: int) -> dict[int, np.ndarray]:
    """By label, the k directions of most weight (not centred) of the class's vectors, as rows."""
    out = {}
    for (label,) in features.select("label").distinct().orderBy("label").collect():
        _, s = moments_matrix(features.where(F.col("label") == label).select("vec"))
        out[label] = np.linalg.eigh(s[1:, 1:])[1][:, ::-1][:, :k].T
    return out


def classify_by_subspace(features: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """object_idx, label: the class on whose subspace the vector's projection is longest, ties to the least label."""
    sent = features.sparkSession.sparkContext.broadcast((np.array(sorted(bases)), np.stack([bases[k] for k in sorted(bases)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, u = sent.value
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float)
            if len(x):
                norms = (np.einsum("ckd,nd->nck", u, x) ** 2).sum(2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels[np.round(norms, 9).argmax(1)].astype(np.int64))], ["object_idx", "label"])

    return features.select("object_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "object_idx long, label long")


def kernel_map(v, order: int = 1, period: float = 0.65):
    """An explicit map whose inner products approach the chi-square kernel of non-negative vectors: 2 order + 1 numbers a component."""

    def part(x):
        root = F.sqrt(x)
        log = F.log(F.when(x > 0, x).otherwise(1.0))
        terms = [root * math.sqrt(period)]
        for k in range(1, order + 1):
            scale = math.sqrt(2 * period / math.cosh(math.pi * k * period))
            terms += [root * scale * F.cos(k * period * log), root * scale * F.sin(k * period * log)]
        return F.array(*terms)

    return F.flatten(F.transform(v, part))


def linear_svm(rows: DataFrame, cost: float = 1.0, rounds: int = 60) -> np.ndarray:
    """rows (vec, y in -1, 1) to weights, the last one the intercept: the squared hinge loss with a ridge, by
    accelerated gradients that tasks sum."""
    dim = rows.select(F.size("vec").alias("n")).first()["n"] + 1
    n = rows.count()
    w = at = np.zeros(dim)

    def gradient(w: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, acc = sent.value, np.zeros(dim)
            for b in batches:
                x, y = np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy().astype(float)
                if len(x):
                    x = np.column_stack([x, np.ones(len(x))])
                    acc -= 2 * (y * np.maximum(0, 1 - y * (x @ w))) @ x
            yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["g"])

        g = rows.select(F.col("vec").cast("array<double>").alias("vec"), F.col("y").cast("long").alias("y")).mapInArrow(run, "g array<double>")
        return np.array(g.agg(F.array(*[F.sum(F.col("g")[j]) for j in range(dim)]).alias("g")).first()["g"])

    longest = rows.agg(F.max(V.norm("vec"))).first()[0] ** 2 + 1
    step = 1 / (1 / (cost * n) + 2 * longest)
    for k in range(rounds):
        new = at - step * (gradient(at) / n + np.append(at[:-1], 0) / (cost * n))
        at, w = new + k / (k + 3) * (new - w), new
    return w


def decision(vec, w: np.ndarray):
    return V.dot(vec, F.array(*[F.lit(float(x)) for x in w[:-1]])) + float(w[-1])


def grid_search(rows: DataFrame, costs: list[float], folds: int = 3, rounds: int = 30) -> list[tuple[float, float]]:
    """rows (object_idx, vec, y) to (cost, accuracy over the folds), the best first; ties prefer the smaller cost."""
    part = F.pmod(F.xxhash64("object_idx"), F.lit(folds))
    out = []
    for c in costs:
        right = total = 0
        for f in range(folds):
            w = linear_svm(rows.where(part != f), c, rounds)
            r = rows.where(part == f).agg(F.count_if((decision("vec", w) > 0) == (F.col("y") > 0)).alias("right"), F.count("*").alias("n")).first()
            right, total = right + r["right"], total + r["n"]
        out.append((c, right / max(1, total)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def select_components(rows: DataFrame, k: int) -> list[int]:
    """rows (vec, y) to the k components that greedily explain y best by least squares; sums over rows once, then the driver."""
    _, m = moments_matrix(rows.select(F.concat(F.col("vec").cast("array<double>"), F.array(F.col("y").cast("double"))).alias("vec")))
    last, chosen = len(m) - 1, []
    for _ in range(k):
        def rest(j: int) -> float:
            i = [0, *(c + 1 for c in chosen), j + 1]
            a = m[np.ix_(i, i)] + 1e-9 * np.eye(len(i))
            return float(m[last, last] - m[last, i] @ np.linalg.solve(a, m[i, last]))

        chosen.append(min((j for j in range(last - 1) if j not in chosen), key=lambda j: (round(rest(j), 9), j)))
    return chosen
