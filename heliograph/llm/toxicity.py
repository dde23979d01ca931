"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney bigram models, one of toxic and one of ordinary labelled texts,
both in the backoff form: a pair that was seen has its own probability, any
other word that of the lower order times its context's backoff weight, which
makes each context's probabilities sum to 1. Counts are continuation counts, so
copies of a text, which repeat its contexts, add nothing.

Rare expressions are smoothed through counts that the classes share. Words'
lower-order estimates have one backoff mass and one base distribution for both
classes; and where the two classes' estimates differ by less than TIE, both
models take the estimate of the pooled counts: a sample's mix of languages and
topics alone shifts words by that much, which over hundreds of words would drown
a few telling ones. Pairs back off to pooled pairs in the same way; a pair whose
word tells the classes apart is left to the lower order.

A text's score is a logistic of the difference of its two log-likelihoods per
word, with the logistic fitted on labelled rows that the models haven't seen.

Bounds: the models are fitted on about TRAIN_WORDS words a class, of labelled
rows drawn whole by a hash of their id; hence so is what is broadcast. Counts
of labelled rows and their words, which set the rates, cover all of them.

Defined results: null and empty texts are an end alone and get the score that
its probabilities give; labels that are null or conflict are not learned from;
without labels of both classes the score is the share of toxic ones (0 without
any). Repeated rows repeat. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import staged, table
from .lookup import Lookup
from .text import columns, fold, n_words, own, value

TRAIN_WORDS = 600_000
#: The absolute discount. Up to so many contexts are taken away whole, so what is
#: rare in a class is left to the shared counts.
DISCOUNT = 4
#: In nats: estimates of the classes closer than this (one is less than 20 times the other) are shared.
TIE = 3.0
#: A difference per word beyond this is certain; it bounds what one odd row does to the logistic.
CERTAIN = 1.0
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Word numbers: an end, which stands on either side of a text, and any word that wasn't learned.
END, UNKNOWN = 0, 1


def tokens(text: str | None) -> list[bytes]:
    return [w.strip(_STRIP) for w in (text or "").encode().lower().split()]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


class Comparison:
    """log p(toxic) and log p(ordinary) of texts; class 0 is ordinary, 1 toxic."""

    def __init__(self, texts: Iterable[list[bytes]], toxic: list[int]):
        self.vocabulary: dict[bytes, int] = {}
        numbered = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in t), np.int64, len(t)) for t in texts]
        self.size = len(self.vocabulary) + 2
        keys, counts = self._continuations(numbered, toxic)
        before, word = keys // self.size, keys % self.size
        lower, pooled, tied = self._words(np.stack([np.bincount(word, c > 0, self.size) for c in counts]))
        keep = tied[word]
        pairs = self._pairs(before, word, counts, pooled, keep)
        before, word = before[keep], word[keep]
        back = []
        for p, q in zip(lower, pairs):
            # A context's pairs leave some probability for all other words.
            held = np.bincount(before, q, self.size)
            q *= np.where(held > 0.999, 0.999 / np.maximum(held, 1e-300), 1.0)[before]
            rest = 1 - np.bincount(before, p[word], self.size)
            back.append(np.log((1 - np.minimum(held, 0.999)) / np.maximum(rest, 1e-300)))
        self.word, self.back = np.log(lower), np.stack(back)
        self.pairs = Lookup(keys[keep].astype(np.uint64))
        self.pair = np.log(pairs)[:, self.pairs.order]
        self.a, self.b = 1.0, 0.0

    def _continuations(self, texts: list[np.ndarray], toxic: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words (before * size + word), sorted, and how many different words stand before each pair in either class."""
        triples: list[list[np.ndarray]] = [[], []]
        for t, y in zip(texts, toxic):
            x = np.concatenate([[END, END], t, [END]])
            triples[y].append((x[:-2] * self.size + x[1:-1]) * self.size + x[2:])
        found = [np.unique(np.unique(np.concatenate(t)) % self.size**2, return_counts=True) if t else (np.zeros(0, np.int64),) * 2 for t in triples]
        keys = np.union1d(found[0][0], found[1][0])
        counts = np.zeros((2, len(keys)))
        for y, (k, n) in enumerate(found):
            counts[y, np.searchsorted(keys, k)] = n
        return keys, counts

    def _words(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From continuation counts [class, word]: each class's lower order, the pooled one, and which words share it."""
        base, every = 1 / self.size, n.sum(0)
        spared = np.maximum(every - DISCOUNT, 0)
        pooled = spared / every.sum() + (1 - spared.sum() / every.sum()) * base
        spared = np.maximum(n - DISCOUNT, 0)
        # One backoff mass for both classes, so that an unknown word favours neither.
        kept = spared.sum() / every.sum()
        p = np.stack([kept * s / s.sum() + (1 - kept) * base if s.sum() else pooled for s in spared])
        tied = np.abs(np.log(p[1] / p[0])) < TIE
        p[:, tied] = pooled[tied]
        p[:, tied] *= ((1 - p[:, ~tied].sum(1)) / p[:, tied].sum(1))[:, None]
        return p, pooled, tied

    def _pairs(self, before: np.ndarray, word: np.ndarray, counts: np.ndarray, pooled: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """[class, pair] for the pairs to keep: discounted counts, and pooled pairs by the mass that the discounts free."""

        def estimate(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
            total, freed = np.bincount(before, c, self.size), np.bincount(before, np.minimum(c, DISCOUNT), self.size)
            weight = np.where(total > 0, _share(freed, total), 1.0)
            return _share(np.maximum(c - DISCOUNT, 0), total[before]) + weight[before] * lower

        shared = estimate(counts.sum(0), pooled[word])
        q = np.stack([estimate(c, shared) for c in counts])
        close = np.abs(np.log(q[1] / q[0])) < TIE
        q[:, close] = shared[close]
        return q[:, keep]

    def log_likelihoods(self, texts: list[list[bytes]]) -> np.ndarray:
        """[text, class]: the mean log-probability of a text's words and its end."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths)
        ids = np.full(int(lengths.sum()), END, np.int64)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        ids[inner] = np.fromiter((self.vocabulary.get(w, UNKNOWN) for t in texts for w in t), np.int64, int(inner.sum()))
        before = np.concatenate([[END], ids[:-1]])  # the end of one text is the start of the next
        at = self.pairs.find((before * self.size + ids).astype(np.uint64))
        value = self.back[:, before] + self.word[:, ids]
        value[:, at >= 0] = self.pair[:, at[at >= 0]]
        return (np.add.reduceat(value, ends - lengths, axis=1) / lengths).T if len(texts) else np.zeros((0, 2))

    def differences(self, texts: list[list[bytes]]) -> np.ndarray:
        ordinary, toxic = self.log_likelihoods(texts).T
        return np.clip(toxic - ordinary, -CERTAIN, CERTAIN)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A logistic of x by Newton's method, with a weak prior that keeps it finite."""
        if not len(x) or y.min() == y.max():
            return
        scale = x.std() or 1.0
        z = np.column_stack([x / scale, np.ones_like(x)])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            w -= np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w)
        self.a, self.b = w[0] / scale, w[1]

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.differences(texts) + self.b, -60, 60)))


def learn(docs: DataFrame, marked: DataFrame, train_words: int = TRAIN_WORDS) -> Comparison | float:
    """docs: the doc_id and text to learn from; marked: doc_id, toxic.

    The draw needs ids and sizes only, so no text is moved: the drawn ids, each
    of at least one of the bounded number of words, are broadcast to the texts.
    """
    sized = staged(docs.select("doc_id", (n_words(F.col("text")) + 1).alias("n")).join(marked, "doc_id"), "toxic-sizes")
    sizes = {r["toxic"]: r["n"] for r in sized.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("toxic") == y, min(1.0, 1.25 * train_words / n)).otherwise(rate)
    ids = sized.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate * 1_000_003).groupBy("doc_id").agg(F.first("toxic").alias("toxic"))
    drawn = docs.join(F.broadcast(ids), "doc_id").withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(5)) > 0).orderBy("doc_id", "text").collect()
    model = Comparison((tokens(r["text"]) for r in drawn if r["fit"]), [r["toxic"] for r in drawn if r["fit"]])
    rest = [r for r in drawn if not r["fit"]]
    if rest:
        # Classes were drawn at different rates, so 0.5 splits an even prior.
        model.calibrate(model.differences([tokens(r["text"]) for r in rest]), np.array([r["toxic"] for r in rest], float))
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, into: str = "_score") -> DataFrame:
    """docs with a score in the column `into`, in place of one of that name; learned from the labels outside fold 0."""
    marked = columns(labels, doc_id="long", toxic="int").dropna().groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t2")).where("toxic = t2 and toxic in (0, 1)").drop("t2")
    d = columns(docs, doc_id="long", text="string")
    model = learn(d.where(fold(F.col("doc_id"), folds) != 0), marked)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    kept = docs.drop(into)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts, out, k = batch.column(batch.num_columns - 1), [], 0
            while k < len(texts):
                part = [tokens(t) for t in texts.slice(k, 500).to_pylist()]
                out.append(np.full(len(part), m) if isinstance(m, float) else m.score(part))
                k += 500
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*names, into])

    # Columns go to Python by number, whatever their names; what is scored rides along as the last one.
    given = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(own(kept))], value(docs, "text", "string").alias("text"))
    return given.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"), into="score")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
