"""Language-model scoring by context-tree weighting over bytes.

A text is read as its lower-cased words, each followed by a space, and an end
in place of the last space, so the model and the word-count base below give
probabilities of the same event. Every context of 0 to DEPTH bytes predicts the
next byte by its binary decomposition: 255 Krichevsky-Trofimov estimators, one
for each prefix of bits. A context's weighted probability is the mean of its own
estimate and the product of those of its one byte longer contexts; the same
weights, turned into predictions, mix the estimates along the path of a position
from the longest context that was seen to the empty one. A text's code length is
minus the sum of its logarithms.

What the model learns from all training texts are counts of runs of DEPTH + 1
bytes (counts of shorter ones are sums of these) and of words. They are summed by
key in Spark. A scorer holds one shard of them at a time: SHARD rows at most on
average, cut by the last two bytes of the context or by the word's hash, and
documents are passed over once for each shard, so memory stays bounded whatever
the corpus holds and no count is dropped. The two shortest orders, at most 65,536
contexts, are worked out once on the driver from sums by context.

Defined results: null and empty texts consist of an end; without training texts
every byte has the probability of an empty tree, 1/256; rows with a null id
count as the id of empty text in the fold; repeated rows repeat. Only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged, table, trim
from .lookup import Lookup
from .text import columns, fold

DEPTH = 5
SHARD = 6_000_000
BLOCK = 1 << 19
END = xxhash.xxh64_intdigest(b"\n")
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def serial(w: list[bytes]) -> bytes:
    return b" ".join(w) + b"\n"


def _hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def grams(texts: list[bytes]) -> np.ndarray:
    """Each byte of the texts with the DEPTH bytes before it, as one number; ends stand before the start."""
    pad = b"\n" * DEPTH
    b = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    n = len(b) - DEPTH
    key = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        key <<= _U(8)
        key |= b[i : i + n]
    if len(texts) > 1:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + DEPTH)[:-1] - DEPTH
        keep = np.ones(n, bool)
        for i in range(DEPTH):
            keep[ends + i] = False
        key = key[keep]
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def counts(docs: DataFrame) -> DataFrame:
    """docs (text) to word (boolean), key, n: all words and runs of bytes, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def out(kind: int) -> pa.RecordBatch:
            k, c = _merged(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind == 1)), pa.array(k.view(np.int64)), pa.array(c)], ["word", "key", "n"])

        def add(ws: list[list[bytes]]) -> None:
            for kind, keys in enumerate((grams([serial(w) for w in ws]), np.concatenate([*map(_hashes, ws), np.full(len(ws), END, np.uint64)]))):
                k, c = np.unique(keys, return_counts=True)
                held[kind].append((k, c.astype(np.int64)))
                if len(held[kind]) > 8:
                    held[kind] = [_merged(held[kind])]

        for batch in batches:
            ws, size = [], 0
            for t in batch.column(0):
                w = words(t.as_py())
                ws.append(w)
                size += len(w)
                if size > BLOCK // 8:
                    add(ws)
                    ws, size = [], 0
            if ws:
                add(ws)
            for kind in (0, 1):  # what a task holds is bounded, however large its partition
                if sum(len(k) for k, _ in held[kind]) > 1_500_000:
                    yield out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield out(kind)
        trim()

    return docs.select("text").mapInArrow(run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


_STEP = np.array([math.lgamma(n / 2) for n in range(1, 8193)])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of gamma at multiples of a half: a table, and Stirling's series beyond it."""
    small = x < 4000
    out = np.empty(len(x))
    out[small] = _STEP[(2 * x[small]).astype(np.int64) - 1]
    y = x[~small]
    out[~small] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y)
    return out


def estimates(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys: context << 8 | byte, sorted, with counts. The probability of each byte in
    its context; where each context begins; the logarithm of the block probability of each context."""
    if not len(keys):
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
    half = math.lgamma(0.5)
    log_p = np.zeros(len(keys))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] >> _U(8) != keys[:-1] >> _U(8)]))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    block = np.zeros(len(starts))
    above = None
    for bits in range(9):
        node = keys >> _U(8 - bits)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        total = np.add.reduceat(n, first).astype(np.float64)
        here = np.repeat(total, np.diff(np.append(first, len(keys))))
        del node
        if bits:
            above += 1
            np.divide(here + 0.5, above, out=above)
            log_p += np.log(above, out=above)
            block += np.bincount(owner[first], lgamma(total + 0.5) - half, len(starts))
        if bits < 8:
            block -= np.bincount(owner[first], lgamma(total + 1), len(starts))
        above = here
    return np.exp(log_p), starts, block


class Tree:
    """The contexts of `least` to DEPTH bytes in a table of counted runs."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, least: int = 2):
        """keys are sorted."""
        self.least = least
        self.keys: dict[int, np.ndarray] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        weighted = longer = None
        at = np.arange(len(keys), dtype=np.int32)  # the place of each key's run among those of this depth
        for d in range(DEPTH, least - 1, -1):
            if d < DEPTH:
                short = self.keys[d + 1] & _U((1 << 8 * (d + 1)) - 1)
                k, back = np.unique(short, return_inverse=True)
                n = np.bincount(back, n, len(k)).astype(np.int64)
                at = back.astype(np.int32)[at]
                del short, back
            else:
                k = keys
            self.keys[d], self.sums[d] = k, np.concatenate([[0], np.cumsum(n)])
            p, starts, block = estimates(k, n)
            ctx = k[starts] >> _U(8)
            self.contexts[d] = ctx
            if d < DEPTH:
                parent = np.searchsorted(ctx, longer & _U((1 << 8 * d) - 1))
                split = np.bincount(parent, weighted, len(ctx))
                weighted = np.logaddexp(block, split) - math.log(2)
                self.own[d] = np.exp(np.minimum(0, block - math.log(2) - weighted))
                which = np.repeat(np.arange(len(ctx)), np.diff(np.append(starts, len(k))))
                w = self.own[d][which[at]]
                mix *= 1 - w
                w *= p[at]
                mix += w
                del which, w
            else:
                weighted, self.own[d] = block, np.ones(len(ctx))
                mix = p
            longer = ctx
        #: By context of `least` bytes: the logarithm of its weighted probability.
        self.weighted = weighted
        mix = mix.astype(np.float32)
        del at, p
        self.table = Lookup(keys)
        self.p = mix[self.table.order]
        del self.table.order

    def _estimate(self, d: int, q: np.ndarray) -> np.ndarray:
        """The Krichevsky-Trofimov probability of the byte of each q in its context of d bytes, seen there or not."""
        k, sums = self.keys[d], self.sums[d]
        out, above = np.ones(len(q)), None
        for bits in range(9):
            low = (q >> _U(8 - bits)) << _U(8 - bits)
            here = sums[np.searchsorted(k, low + _U(1 << (8 - bits)))] - sums[np.searchsorted(k, low)]
            if bits:
                out *= (here + 0.5) / (above + 1)
            above = here
        return out

    def predict(self, q: np.ndarray) -> np.ndarray:
        """The weighted probability of each run's last byte, by contexts of `least` bytes and longer; 0 where there is none."""
        at = self.table.find(q)
        out = np.where(at >= 0, self.p[at] if len(self.p) else 0, 0).astype(np.float64)
        new = np.flatnonzero(at < 0)
        if new.size:
            uniq, back = np.unique(q[new], return_inverse=True)
            p, any_ = np.zeros(len(uniq)), np.zeros(len(uniq), bool)
            for d in range(DEPTH, self.least - 1, -1):
                x = uniq & _U((1 << 8 * (d + 1)) - 1)
                ctx = self.contexts[d]
                if not len(ctx):
                    continue
                i = np.minimum(np.searchsorted(ctx, x >> _U(8)), len(ctx) - 1)
                seen = np.flatnonzero(ctx[i] == x >> _U(8))
                kt = self._estimate(d, x[seen])
                w = np.where(any_[seen], self.own[d][i[seen]], 1.0)
                p[seen] = w * kt + (1 - w) * p[seen]
                any_[seen] = True
            out[new] = p[back]
        return out


def short_orders(pairs: dict[int, int], weighted: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts of (byte before << 8 | byte) and the weighted probabilities of all contexts of two bytes:
    what the contexts of 0 and 1 bytes add to a prediction, [before, byte], the share that longer ones
    have, [before], and the prediction where there is no longer one, [before, byte]."""
    k = np.array(sorted(pairs), np.uint64)
    n = np.array([pairs[int(x)] for x in k], np.int64)
    add, share = np.full((256, 256), 1 / 256), np.zeros(256)
    if not len(k):
        return add, share, add
    single, back = np.unique(k & _U(255), return_inverse=True)
    _, _, root = estimates(single, np.bincount(back, n).astype(np.int64))
    _, starts, block = estimates(k, n)
    before = (k[starts] >> _U(8)).astype(np.int64)
    split = np.bincount(np.searchsorted(before, (contexts & _U(255)).astype(np.int64)), weighted, len(before))
    w1 = np.logaddexp(block, split) - math.log(2)
    own1 = np.exp(np.minimum(0, block - math.log(2) - w1))
    w0 = np.logaddexp(root[0], w1.sum()) - math.log(2)
    own0 = math.exp(min(0, root[0] - math.log(2) - w0))
    dense = np.zeros((256, 256))
    dense[(k >> _U(8)).astype(np.int64), (k & _U(255)).astype(np.int64)] = n

    def kt(rows: np.ndarray) -> np.ndarray:
        out, above = np.ones_like(rows), rows.sum(1, keepdims=True)
        for bits in range(1, 9):
            here = np.repeat(rows.reshape(len(rows), 1 << bits, -1).sum(2), 256 >> bits, 1)
            out *= (here + 0.5) / (above + 1)
            above = here
        return out

    zero, one = kt(dense.sum(0, keepdims=True)), kt(dense)
    bare = np.repeat(zero, 256, 0)  # after an unseen byte, the empty context decides alone
    bare[before] = own0 * zero + (1 - own0) * one[before]
    add = bare.copy()
    add[before] = own0 * zero + (1 - own0) * own1[:, None] * one[before]
    share[before] = (1 - own0) * (1 - own1)
    return add, share, bare


def _shard(df: DataFrame, word: bool, s: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """One shard of the counts as arrays, sorted; cut by the two bytes before the last, or by the word."""
    part = F.pmod("key", F.lit(shards)) if word else F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(shards))
    got = df.where((F.col("word") == word) & (part == s)).select("key", "n").toArrow()
    key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _narrow(shard: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts in 32 bits where they fit."""
    key, n = shard
    return key, n.astype(np.int32) if len(n) and n.max() < 2**31 else n


def _orders(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The short orders, from sums by context that tasks work out for the contexts of two bytes they hold whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            k, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
            order = np.argsort(k)
            tree = Tree(k[order], n[order])
            ctx = tree.contexts[2]
            yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(tree.weighted)], ["context", "weighted"])

    g = df.where("not word").withColumn("context", F.shiftright("key", 8).bitwiseAND(0xFFFF))
    parts = max(1, math.ceil(g.count() / 300_000))
    rows = g.repartition(parts, "context").select("key", "n").mapInArrow(run, "context long, weighted double").toArrow()
    pairs = g.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("k")).agg(F.sum("n").alias("n")).collect()
    return short_orders({r["k"]: r["n"] for r in pairs}, rows.column("weighted").to_numpy(), rows.column("context").to_numpy().view(np.uint64))


class Scorer:
    """One shard, ready to use; built once by each worker from the broadcast arrays."""

    def __init__(self, sent: tuple):
        (k, n), (wk, wn), (self.add, self.share, self.bare), self.total, self.distinct, self.s, self.shards, self.parts = sent
        self.tree = Tree(k, n)
        self.words, self.n = Lookup(wk, spread=False), wn
        self.unknown = math.log10(0.1 / (self.total + 0.1 * (self.distinct + 1)))
        trim()  # what building it took, some 150 MB for 4 million rows, would stay with the worker

    def score(self, ws: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Per text, over what this shard decides: known tokens, base, score."""
        lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        h = np.concatenate([np.append(_hashes(w), _U(END)) for w in ws])
        owner = np.repeat(np.arange(len(ws)), lengths)
        if self.shards > 1:
            mine = np.mod(h.view(np.int64), self.shards) == self.s
            h, owner = h[mine], owner[mine]
        at = self.words.find(h)
        have = at >= 0
        known = np.bincount(owner, have, len(ws)).astype(np.int64)
        value = np.full(len(at), self.unknown)
        value[have] = np.log10((self.n[at[have]] + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        base = np.bincount(owner, value, len(ws))
        texts = [serial(w) for w in ws]
        q = grams(texts)
        owner = np.repeat(np.arange(len(ws)), np.fromiter(map(len, texts), np.int64, len(ws)))
        if self.shards > 1:
            mine = self.parts[((q >> _U(8)) & _U(0xFFFF)).astype(np.int64)] == self.s
            q, owner = q[mine], owner[mine]
        before = ((q >> _U(8)) & _U(255)).astype(np.int64)
        byte = (q & _U(255)).astype(np.int64)
        p = self.tree.predict(q)
        p = np.where(p > 0, self.add[before, byte] + self.share[before] * p, self.bare[before, byte])
        return known, base, np.bincount(owner, np.log10(p), len(ws))


_built: dict[str, Scorer] = {}


def score(docs: DataFrame, folds: int = 10, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learned outside fold 0."""
    spark = docs.sparkSession
    d = columns(docs, doc_id="long", text="string").withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
    found = staged(counts(d.where(~F.col("held_out"))), "ctw-counts")
    sizes = {r["word"]: (r["rows"], r["n"]) for r in found.groupBy("word").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    distinct, total = sizes.get(True, (0, 0))
    shards = max(1, math.ceil(sum(x for x, _ in sizes.values()) / shard))
    orders = _orders(found)
    parts = None
    if shards > 1:
        cut = spark.range(65536).select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s"), "id").toArrow()
        parts = np.empty(65536, np.int32)
        parts[cut.column("id").to_numpy()] = cut.column("s").to_numpy()
        d = staged(d.withColumn("row", F.monotonically_increasing_id()), "ctw-documents")
    else:
        d = d.withColumn("row", F.lit(0).cast("long"))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, n_bytes long, base_score double, score double"
    passes = []
    for s in range(shards):
        sent = spark.sparkContext.broadcast((_shard(found, False, s, shards), _narrow(_shard(found, True, s, shards)), orders, total, distinct, s, shards, parts))
        name = f"{id(sent)}-{sent._jbroadcast.id()}-{spark.sparkContext.applicationId}"

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                trim()
                _built[name] = Scorer(sent.value)
            scorer = _built[name]
            for batch in batches:
                texts, k = batch.column("text"), 0
                while k < batch.num_rows:
                    ws, size, first = [], 0, k
                    while k < batch.num_rows and size < BLOCK // 8:
                        ws.append(words(texts[k].as_py()))
                        size += len(ws[-1]) + 1
                        k += 1
                    known, base, value = scorer.score(ws)
                    keep = [batch.column(c).slice(first, len(ws)) for c in ("doc_id", "held_out", "row")]
                    n = pa.array([len(w) + 1 for w in ws], pa.int64())
                    length = pa.array([sum(map(len, w)) + max(1, len(w)) for w in ws], pa.int64())
                    yield pa.RecordBatch.from_arrays([*keep, n, pa.array(known), length, pa.array(base), pa.array(value)], ["doc_id", "held_out", "row", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

        got = d.select("doc_id", "held_out", "row", "text").mapInArrow(run, schema)
        passes.append(got if shards == 1 else staged(got, "ctw-pass"))
    if shards == 1:
        out = passes[0]
    else:
        out = passes[0]
        for p in passes[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")], *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    bits = -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total or 0).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
