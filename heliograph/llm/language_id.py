"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are read as lower-cased bytes in windows of WINDOW, each window a row of
a batch. Two gated recurrent units, one from either end, label every position;
a document's probabilities are the means over its positions, those of letters
(all bytes from 128 on count as letters) if it has any. The network is trained in
numpy by backpropagation through time, with Adam.

Bounds: it is fitted on whole labelled documents of about TRAIN_BYTES per
language, drawn by a hash of their id; every window of a drawn document can be
met, as each step draws documents and then one window of each. Sizes by language
cover all labelled rows. What is broadcast is a few thousand weights.

Defined results: `und` with score 0 where a text is null or has no letter (a
character of Unicode category L), and everywhere if nothing is labelled; a single learned language gets score 1; rows
whose language is null teach nothing; repeated rows repeat. Only doc_id, text
and lang are read, lang for training alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .text import columns, fold, whole

WINDOW = 64
HIDDEN = 8
TRAIN_BYTES = 1_600_000
STEPS = 240
BATCH = 256
BLOCK = 1024
RATE = 0.02
_WEIGHT = np.array([0, *[1.0 if chr(b).isalpha() or b >= 128 else 1e-6 for b in range(1, 256)]], np.float32)


class Network:
    """Both directions at once: arrays have a leading axis of 2, the second one reads backwards."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        h, c = HIDDEN, len(labels)
        self.labels = labels
        self.w = {"e": r.normal(0, 0.3, (2, 256, 3 * h)), "u": r.normal(0, 0.3, (2, h, 3 * h)), "v": r.normal(0, 0.3, (2, h, c)), "b": np.zeros(c)}
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (rows, WINDOW) bytes; to the state at every position, (2, WINDOW, rows, HIDDEN)."""
        h, rows = HIDDEN, len(x)
        e, u = self.w["e"].reshape(512, 3 * h), self.w["u"]
        # The gates and the candidate apart, so that all arrays of a step are contiguous.
        e1, e2, u1, u2 = (np.ascontiguousarray(y) for y in (e[:, : 2 * h], e[:, 2 * h :], u[..., : 2 * h], u[..., 2 * h :]))
        read = np.stack([x.T, x.T[::-1].astype(np.int64) + 256], 1).astype(np.int64).reshape(WINDOW, -1)
        out = np.empty((2, WINDOW, rows, h), np.float32)
        s = np.zeros((2, rows, h), np.float32)
        for t in range(WINDOW):
            zr = e1.take(read[t], axis=0).reshape(2, rows, 2 * h)
            zr += s @ u1
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h], zr[..., h:]
            n = e2.take(read[t], axis=0).reshape(2, rows, h)
            g = s @ u2
            n += r * g
            np.tanh(n, out=n)
            before = s
            s = s - n
            s *= z
            s += n
            out[0, t], out[1, WINDOW - 1 - t] = s
            if keep is not None:
                keep.append((before, z, r, n, g))
        return out

    def by_label(self, states: np.ndarray) -> np.ndarray:
        """(labels, WINDOW * rows): the probabilities of the labels at every position."""
        f, b = states.reshape(2, -1, HIDDEN)
        p = self.w["v"][0].T @ f.T
        p += self.w["v"][1].T @ b.T
        p += self.w["b"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(WINDOW, rows, labels)"""
        return np.ascontiguousarray(self.by_label(states).T).reshape(*states.shape[1:3], -1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        h, rows = HIDDEN, len(x)
        kept: list = []
        states = self.forward(x, kept)
        d = self.probabilities(states)
        d[:, np.arange(rows), y] -= 1
        d *= (mask.T / max(1, mask.sum()))[..., None]
        g = {k: np.zeros_like(w) for k, w in self.w.items()}
        for k in (0, 1):
            g["v"][k] = np.einsum("trh,trc->hc", states[k], d, optimize=True)
        g["b"] = d.sum((0, 1))
        ds = np.stack([d @ self.w["v"][0].T, (d @ self.w["v"][1].T)[::-1]], 1)  # (WINDOW, 2, rows, h) in reading order
        back = np.zeros((2, rows, h), np.float32)
        ut = self.w["u"].transpose(0, 2, 1)
        into = np.empty((2, WINDOW, rows, 3 * h), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            before, z, r, n, gn = kept[t]
            back = back + ds[t]
            dn = back * (1 - z) * (1 - n * n)
            da = np.concatenate([back * (before - n) * z * (1 - z), dn * gn * r * (1 - r), dn], -1)
            dg = da.copy()
            dg[..., 2 * h :] *= r
            g["u"] += before.transpose(0, 2, 1) @ dg
            back = back * z + dg @ ut
            into[:, t] = da
        read = np.stack([x.T, x.T[::-1]])
        for k in (0, 1):
            flat, idx = into[k].reshape(-1, 3 * h), read[k].ravel()
            order = np.argsort(idx, kind="stable")
            used, first = np.unique(idx[order], return_index=True)
            g["e"][k][used] = np.add.reduceat(flat[order], first)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """y: the number of each text's label."""
        x, n = _windows(texts)
        mask, first = (x > 0).astype(np.float32), np.cumsum(n) - n
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(w) for k, w in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for step in range(1, steps + 1):
            docs = r.integers(0, len(n), min(BATCH, len(x)))
            rows = first[docs] + (r.random(len(docs)) * n[docs]).astype(np.int64)
            for k, g in self.gradients(x[rows], mask[rows], y[docs]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.98 * v[k] + 0.02 * g * g
                pace = RATE * (1 - 0.9 * step / steps)
                self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The mean probabilities of each text, over the whole of it."""
        c = len(self.labels)
        x, n = _windows(texts)
        owner = np.repeat(np.arange(len(texts)), n)
        sums = np.zeros((len(texts), c))
        for k in range(0, len(x), BLOCK):
            part = np.ascontiguousarray(x[k : k + BLOCK].T)
            p = self.by_label(self.forward(part.T)).reshape(c, *part.shape)
            # Other characters count by a trace, so that they decide only where there are no letters.
            p *= _WEIGHT[part]
            got = p.sum(1)
            for j in range(c):
                sums[:, j] += np.bincount(owner[k : k + BLOCK], got[j], len(texts))
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, one after the other, and how many each text has."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist())), np.uint8).reshape(-1, WINDOW), n


def learn(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> Network | None:
    """labelled: doc_id, text, lang, without null languages."""
    labelled = labelled.withColumn("bytes", F.octet_length("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum("bytes").alias("n")).collect()}
    if not sizes:
        return None
    labels = sorted(sizes)
    net = Network(labels)
    if len(labels) == 1:
        return net
    rate = F.lit(0.0)
    for k, n in sizes.items():
        rate = F.when(F.col("lang") == k, min(1.0, train_bytes / max(1, n))).otherwise(rate)
    drawn = labelled.where("bytes > 0").where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_003)) < rate * 1_000_003)
    got = drawn.select("doc_id", "lang", "text").orderBy("doc_id", "text", "lang").collect()
    if got:
        net.fit([r["text"].encode().lower() for r in got], np.array([labels.index(r["lang"]) for r in got]))
    return net


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned outside fold 0."""
    d = columns(docs, doc_id="long", text="string", lang="string")
    teach = d.where((fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull()).withColumn("text", whole(F.col("text")))
    sent = docs.sparkSession.sparkContext.broadcast(learn(teach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            names, scores, k = [], [], 0
            while k < batch.num_rows:
                part = batch.column(2).slice(k, 256).to_pylist()
                k += 256
                known = [bool(t and net and has_letter(t)) for t in part]
                p = net.documents([t.encode().lower() for t, y in zip(part, known) if y]) if any(known) else np.zeros((0, 1))
                best = iter(zip(p.argmax(1).tolist(), p.max(1).tolist()))
                for y in known:
                    j, s = next(best) if y else (0, 0.0)
                    names.append(net.labels[j] if y else "und")
                    scores.append(min(1.0, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = d.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
