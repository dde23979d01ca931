"""Self-organizing maps, flat and tree-structured, trained in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _neighbourhood(width: int, height: int, radius: float) -> np.ndarray:
    """(units, units) triangle kernel of the distance on the map."""
    y, x = np.divmod(np.arange(width * height), width)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    return np.maximum(0, 1 - d / (radius + 1))


def _window(parent: np.ndarray, above: tuple[int, int], size: tuple[int, int]) -> np.ndarray:
    """(rows, units) whether a unit lies under the parent or next to it."""
    py, px = np.divmod(parent, above[0])
    y, x = np.divmod(np.arange(size[0] * size[1]), size[0])
    fx, fy = size[0] / above[0], size[1] / above[1]
    near = lambda a, p, f, n: (a[None] >= np.floor(p * f - f)[:, None]) & (a[None] <= np.minimum(n - 1, np.ceil(p * f + 2 * f - 1))[:, None])
    return near(x, px, fx, size[0]) & near(y, py, fy, size[1])


def _best(x: np.ndarray, levels: list[np.ndarray], sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The best-matching unit of each row at every level, each searched near that of the level above."""
    out: list[np.ndarray] = []
    for k, m in enumerate(levels):
        d = (x * x).sum(1)[:, None] - 2 * x @ m.T + (m * m).sum(1)
        if k:
            d = np.where(_window(out[-1], sizes[k - 1], sizes[k]), d, np.inf)
        out.append(d.argmin(1))
    return out


def _sums(features: DataFrame, levels: list[np.ndarray], sizes: list[tuple[int, int]]) -> np.ndarray:
    """(units, 1 + components) counts and sums by best unit of the last level; one small row a unit from each task."""
    sent = features.sparkSession.sparkContext.broadcast((levels, sizes))
    units, dim = levels[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sizes = sent.value
        acc = np.zeros((units, dim + 1))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                u = _best(x, levels, sizes)[-1]
                np.add.at(acc, u, np.column_stack([np.ones(len(x)), x]))
        yield pa.RecordBatch.from_arrays([pa.array(range(units), pa.int32()), pa.array(acc.tolist(), pa.list_(pa.float64()))], ["unit", "acc"])

    got = features.select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "unit int, acc array<double>")
    got = got.groupBy("unit").agg(F.array(*[F.sum(F.col("acc")[j]) for j in range(dim + 1)]).alias("acc")).collect()
    acc = np.zeros((units, dim + 1))
    for r in got:
        acc[r["unit"]] = r["acc"]
    return acc


class TreeSom:
    """A stack of maps; each starts from the one above it and is trained with a shrinking neighbourhood."""

    def __init__(self, sizes: list[tuple[int, int]]):
        self.sizes, self.levels = sizes, []

    def fit(self, features: DataFrame, rounds: int = 4, seed: int = 0) -> TreeSom:
        first = features.select(F.avg(F.size("vec")).cast("int").alias("d")).first()["d"]
        r = np.random.default_rng(seed)
        for k, (w, h) in enumerate(self.sizes):
            if k:
                above = self.levels[-1].reshape(self.sizes[k - 1][1], self.sizes[k - 1][0], -1)
                y, x = np.divmod(np.arange(w * h), w)
                m = above[y * above.shape[0] // h, x * above.shape[1] // w] + r.normal(0, 1e-3, (w * h, first))
            else:
                m = r.normal(0, 0.1, (w * h, first))
            self.levels.append(m)
            for t in range(rounds):
                acc = _sums(features, self.levels, self.sizes)
                n = _neighbourhood(w, h, max(1.0, min(12, w / 2) * (1 - t / rounds))) @ acc
                have = n[:, 0] > 1e-12
                self.levels[-1][have] = n[have, 1:] / n[have, :1]
        return self

    def bmu(self, features: DataFrame) -> DataFrame:
        """object_idx, level, unit, x, y, distance."""
        sent = features.sparkSession.sparkContext.broadcast((self.levels, self.sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, sizes = sent.value
            for b in batches:
                x = np.array(b.column(1).to_pylist(), float)
                if not len(x):
                    continue
                for k, u in enumerate(_best(x, levels, sizes)):
                    y, c = np.divmod(u, sizes[k][0])
                    d = ((x - levels[k][u]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(u), k, np.int32)), *[pa.array(a.astype(np.int32)) for a in (u, c, y)], pa.array(d)], ["object_idx", "level", "unit", "x", "y", "distance"])

        return features.select("object_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "object_idx long, level int, unit int, x int, y int, distance double")
