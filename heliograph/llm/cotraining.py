"""Quality classifier by co-training.

Two views of a document: its content (hashed words, shapes of words and how they
repeat) and its page's metadata (source, language, length). A logistic model of
each is fitted on labelled rows. In every round both models score all unlabelled
rows of the training folds; of those that a view is sure of, a draw, as many of
either class as in the labels' proportion, is what the other view learns besides
its labels. At the end each view is calibrated on labelled rows that neither has
learned from, and a logistic of both calibrated views scores every document.

Bounds: about LABELLED labelled rows, drawn whole by a hash of the id, and
EXCHANGED pseudo-labels a view and round, drawn from all rows that the view is
sure of; counts that set the rates cover all rows. Models are two vectors of
DIMENSIONS weights.

Defined results: a null or empty text has no content features, missing metadata
is a value of its own; labels that are null or conflict are not learned from,
nor are rows without an id; without labels of both classes the score is the
share of good ones (1 without any, so nothing is dropped). Repeated rows repeat.
Only doc_id, text, source, lang and n_chars are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged, table
from .text import columns, fold

DIMENSIONS = 1 << 13
LABELLED = 2000
EXCHANGED = 480
ROUNDS = 2
SURE = 0.9
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")
_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    s = word.translate(_SHAPE)
    if s not in _shapes:
        if len(_shapes) > 100_000:
            _shapes.clear()
        _shapes[s] = zlib.crc32(b"shape " + _RUN.sub(rb"\1\1", s)) % DIMENSIONS
    return _shapes[s]


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of a whole text, of length 1 as a vector, and a bucket for its repetition."""
    count = Counter((text or "").encode().split())
    if not count:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    words = list(count)
    n = np.fromiter(count.values(), np.float32, len(words))
    shapes = np.bincount(np.fromiter(map(_shape, words), np.int64, len(words)), n, DIMENSIONS)
    used = np.flatnonzero(shapes)
    hashed = np.fromiter((zlib.crc32(w.lower()) % DIMENSIONS for w in words), np.int32, len(words))
    unit = lambda v: v / math.sqrt(float((v * v).sum()))
    bucket = [zlib.crc32(b"%s %d" % (name, min(9, int(10 * x)))) % DIMENSIONS for name, x in ((b"distinct", len(words) / n.sum()), (b"common", n.max() / n.sum()))]
    return np.concatenate([hashed, used, bucket]).astype(np.int32), np.concatenate([0.5 * unit(np.sqrt(n)), unit(np.sqrt(shapes[used])), [0.5, 0.5]]).astype(np.float32)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = -1 if n_chars is None or n_chars < 0 else int(2 * math.log2(n_chars + 1))
    names = [f"source {source}", f"lang {lang}", f"size {size}", f"lang {lang} size {size // 2}"]
    return np.array([zlib.crc32(x.encode()) % DIMENSIONS for x in names], np.int32), np.full(4, 0.5, np.float32)


class Sparse:
    """Rows of (feature, value), one after the other."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        n = [len(i) for i, _ in rows]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), n)
        self.col = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], DIMENSIONS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, w: np.ndarray | None = None, steps: int = 80) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic with a ridge, by Nesterov's method."""
    w = np.zeros(DIMENSIONS + 1) if w is None else w.copy()
    at, total = w.copy(), weight.sum()
    for k in range(steps):
        g = weight * (_sigmoid(x.dot(at[:-1]) + at[-1]) - y)
        step = np.append(x.back(g), g.sum()) / total + 2e-5 * np.append(at[:-1], 0)
        new = at - 2.0 * step
        at, w = new + k / (k + 3) * (new - w), new
    return w


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A small dense logistic (intercept last) by Newton's method, with a weak prior."""
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + 0.1 * w)
    return w


class Views:
    """Both views' weights, their calibrations and the combination."""

    def __init__(self, rows: list[tuple]):
        """rows: (content, metadata, label, learn), labelled; those not to learn from calibrate."""
        self.rows = [r for r in rows if r[3]]
        self.held = [r for r in rows if not r[3]] or self.rows
        self.w: list[np.ndarray] = [None, None]  # type: ignore[list-item]
        #: What each view was taught by the other: id to (content, metadata, label).
        self.taught: list[dict[int, tuple]] = [{}, {}]
        self.fit(80)

    def fit(self, steps: int = 30) -> None:
        for v in (0, 1):
            rows = [*self.rows, *self.taught[v].values()]
            y = np.array([r[2] for r in rows], float)
            self.w[v] = fit(Sparse([r[v] for r in rows]), y, np.ones(len(y)), self.w[v], steps)

    def finish(self) -> None:
        """Calibrates the views on the rows held back, and combines them."""
        truth = np.array([r[2] for r in self.held], float)
        raw = self.raw([r[0] for r in self.held], [r[1] for r in self.held])
        self.calibrated = [logistic(raw[:, [v]], truth) for v in (0, 1)]
        self.both = logistic(self.calibrate(raw), truth)
        self.rows, self.held, self.taught = [], [], [{}, {}]  # what scores needs weights alone

    def raw(self, a: list, b: list) -> np.ndarray:
        return np.column_stack([np.clip(Sparse(x).dot(w[:-1]) + w[-1], -20, 20) for x, w in zip((a, b), self.w)])

    def calibrate(self, raw: np.ndarray) -> np.ndarray:
        return np.column_stack([raw[:, v] * c[0] + c[1] for v, c in enumerate(self.calibrated)])

    def score(self, a: list, b: list) -> np.ndarray:
        z = self.calibrate(self.raw(a, b))
        return _sigmoid(z @ self.both[:-1] + self.both[-1])


def _documents(docs: DataFrame) -> DataFrame:
    return columns(docs, doc_id="long", text="string", source="string", lang="string", n_chars="long")


def _features(r: dict) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    return content(r["text"]), metadata(r["source"], r["lang"], r["n_chars"])


def _drawn(d: DataFrame, chosen: DataFrame) -> list[tuple]:
    """(doc_id, what chosen says of it, content, metadata) of the rows of d that chosen (doc_id, what) names.

    Draws are of bounded size by their rates, so their ids are broadcast to the texts.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_features(r) for r in b.to_pylist()]
            cols = [pa.array([x.tolist() for (x, _), _ in got], pa.list_(pa.int32())), pa.array([x.tolist() for (_, x), _ in got], pa.list_(pa.float32())), pa.array([x.tolist() for _, (x, _) in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("what"), *cols], ["doc_id", "what", "i", "v", "m"])

    got = d.join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, what int, i array<int>, v array<float>, m array<int>").orderBy("doc_id", "what", "i", "m").toArrow()
    rows = []
    for b in got.to_batches():
        for r in range(b.num_rows):
            i, v, m = (b.column(c)[r].values.to_numpy() for c in ("i", "v", "m"))
            rows.append((b.column("doc_id")[r].as_py(), b.column("what")[r].as_py(), (i, v), (m, np.full(len(m), 0.5, np.float32))))
    return rows


def _hash(seed: str):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def exchange(views: Views, docs: DataFrame, marked: DataFrame, good: float, seed: str, exchanged: int = EXCHANGED) -> int:
    """One round: rows of the whole table, those that are marked (doc_id) aside, of which a view is sure become the
    other's labels. How many it was. All rows are scored where they lie; only ids and scores meet the marks."""
    sent = docs.sparkSession.sparkContext.broadcast(views.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                got = [_features(r) for r in b.to_pylist()]
                p = [_sigmoid(Sparse([g[v] for g in got]).dot(w[v][:-1]) + w[v][-1]) for v in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[0]), pa.array(p[1])], ["doc_id", "p0", "p1"])

    scored = staged(docs.mapInArrow(run, "doc_id long, p0 double, p1 double"), "cotraining-round").join(marked.select("doc_id").hint("merge"), "doc_id", "left_anti")
    # what = 2 * view + label, for the rows that a view is sure of
    sure = scored.select("doc_id", F.explode(F.array(*[F.when(F.col(f"p{v}") >= SURE, 2 * v + 1).when(F.col(f"p{v}") <= 1 - SURE, 2 * v) for v in (0, 1)])).alias("what")).where("what is not null")
    sure = staged(sure, "cotraining-sure")
    sizes = {r["what"]: r["n"] for r in sure.groupBy("what").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for what, n in sizes.items():
        rate = F.when(F.col("what") == what, min(1.0, exchanged * (good if what % 2 else 1 - good) / n)).otherwise(rate)
    chosen = sure.where(_hash(seed) < rate).distinct()
    n = 0
    for doc, what, a, m in _drawn(docs, chosen):
        view, label = divmod(what, 2)
        n += doc not in views.taught[1 - view]
        views.taught[1 - view][doc] = (a, m, label)
    views.fit()
    return n


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, rounds: int = ROUNDS) -> Views | float:
    d = _documents(docs).where((fold(F.col("doc_id"), folds) != 0) & F.col("doc_id").isNotNull())
    marked = columns(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("what"), F.max("quality").alias("y2")).where("what = y2 and what in (0, 1)").drop("y2")
    ids = staged(d.select("doc_id").distinct().join(marked, "doc_id"), "cotraining-ids")
    sizes = {r["what"]: r["n"] for r in ids.groupBy("what").agg(F.count("*").alias("n")).collect()}
    bad, fine = sizes.get(0, 0), sizes.get(1, 0)
    if not bad or not fine:
        return 0.0 if bad else 1.0
    # Rare bad rows are drawn at up to three times their share.
    rate = {0: min(1.0, max(LABELLED / (bad + fine), min(LABELLED / 3, 3 * LABELLED * bad / (bad + fine)) / bad)), 1: min(1.0, LABELLED / (bad + fine))}
    rows = _drawn(d, ids.where(_hash("co") < F.when(F.col("what") == 0, rate[0]).otherwise(rate[1])))
    rows = [(a, m, y, zlib.crc32(f"learn {doc}".encode()) % 4 != 0) for doc, y, a, m in rows]
    if len({r[2] for r in rows if r[3]}) < 2:
        return fine / (bad + fine)
    views = Views(rows)
    good = min(0.99, max(0.01, sum(r[2] for r in views.rows) / len(views.rows)))
    for k in range(rounds):
        exchange(views, d, marked, good, f"round {k}")
    views.finish()
    return views


def score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (that the document is of quality 1); learned outside fold 0."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                if isinstance(views, float):
                    s = np.full(b.num_rows, views)
                else:
                    s = views.score(*zip(*map(_features, b.to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    d = _documents(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double")


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
