"""Exact top-k search: an inverted index with block-max WAND for BM25.

Documents are indexed in shards of at most SHARD_DOCS rows and about SHARD_WORDS
words: sorted term hashes, and for each term its postings in document order, cut
into blocks of BLOCK_DOCS documents with the best impact of each. A batch of
queries moves through a shard in document order from pivot to pivot: blocks that
the sums of best impacts keep below a query's k-th score are passed over.
Global statistics (documents, mean length, document frequencies of the queries'
terms) are counted over all rows first, so scores are the same in any shard. A
task carries each query's best k from shard to shard and sends them once, and
where shards are many, one in SAMPLED of them is searched first for the scores
that all tasks start from. The best k of all tasks' best k are exact.

Queries go out in blocks of at most QUERY_TERMS distinct terms in all; the index
is written once to the shared folder and read for each block. A shard is the
unit of its pages and batches, so no step holds more than a few of them, however
many there are in a file.

Ranks follow the score rounded to 6 places, then the id. Defined results: null
and empty texts match nothing, as documents and as queries, and count as
documents of length 0; a document is a hit only if it shares a term; repeated
rows are hits of their own; queries that share an id are one, with the least of
their texts, and queries without an id are left out; null ids come last among equals; only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..runtime import WIDE, batches, staged, table, unstage
from .text import columns

K = 10
K1, B = 1.2, 0.75
EVERY = 100
SHARD_DOCS, SHARD_WORDS = 2048, 1_000_000
BLOCK_DOCS = 64
QUERY_TERMS = 2_000_000
#: A term in one of so many documents of a shard is kept as a column of a matrix.
FREQUENT = 16
#: Queries that a shard scores together, and blocks between two looks at the k-th scores.
BATCH, STRIDE = 64, 8
#: Documents that a worker is sent at once. Of the index it is sent one row, a shard of some MB.
SENT = 512
#: One in so many shards is searched first, for scores to start from.
SAMPLED = 16


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes, sorted, and how often each occurs."""
    w = (text or "").encode().lower().split()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), return_counts=True)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: a number by its content, ids, lengths, terms, offsets, postings (local document, term frequency) as packed arrays."""

    def pack(ids: list, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        t = np.concatenate([k for k, _ in parts])
        tf = np.concatenate([c for _, c in parts]).astype(np.int32)
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.argsort(t, kind="stable")
        t, tf, doc = t[order], tf[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        length = np.array([c.sum() for _, c in parts], np.int64)
        arrays = (length, t[first], np.append(first, len(t)).astype(np.int64), doc, tf)
        number = xxhash.xxh32_intdigest(doc.tobytes()) >> 1
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["number", "ids", "length", "terms", "offsets", "doc", "tf"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                parts.append(term_counts(t.as_py()))
                size += len(parts[-1][0])
                if len(ids) >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield pack(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield pack(ids, parts)

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "number int, ids array<long>, length binary, terms binary, offsets binary, doc binary, tf binary")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, terms, counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            got = [term_counts(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i].astype(np.uint64).view(np.int64).tolist() for x in got], pa.list_(pa.int64())) for i in (0, 1)]], ["query_id", "terms", "counts"])

    return columns(queries, doc_id="long", text="string").mapInArrow(run, "query_id long, terms array<long>, counts array<long>")


def statistics(index: DataFrame, terms: DataFrame) -> tuple[int, float, DataFrame]:
    """Documents, their mean length, and (term, df) of the queries' terms."""

    def sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in rows:
            for x in b.column(0):
                length = np.frombuffer(x.as_py(), np.int64)
                n, total = n + len(length), total + int(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    def frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for t, o in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t.as_py(), np.int64)), pa.array(np.diff(np.frombuffer(o.as_py(), np.int64)))], ["term", "df"])

    with batches(index.sparkSession, 1):
        r = index.select("length").mapInArrow(sizes, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    wanted = terms.select(F.explode("terms").alias("term")).distinct()
    df = index.select("terms", "offsets").mapInArrow(frequencies, "term long, df long").join(wanted.hint("merge"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    with batches(index.sparkSession, 1):
        df = staged(df, "search-df")
    return r["n"] or 0, (r["total"] or 0) / max(1, r["n"] or 0), df


class Best:
    """The best k of each query over all that was added: by score, then id, null ids last."""

    def __init__(self, start: np.ndarray, k: int):
        """start: a score that each query's k-th is known to reach, 0 where none is."""
        self.k, self.least = k, start.copy()
        self.score = np.zeros((len(start), k))
        self.no = np.ones((len(start), k), np.int8)
        self.id = np.zeros((len(start), k), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, no: np.ndarray, ids: np.ndarray) -> None:
        """Hits of any queries; scores are above 0."""
        mine, local = np.unique(query, return_inverse=True)
        old = np.repeat(np.arange(len(mine)), self.k)
        q = np.concatenate([old, local])
        s = np.concatenate([self.score[mine].ravel(), score])
        n = np.concatenate([self.no[mine].ravel(), no.astype(np.int8)])
        i = np.concatenate([self.id[mine].ravel(), ids])
        order = np.lexsort((i, n, -s, q))
        first = np.searchsorted(q[order], np.arange(len(mine)))
        take = order[first[:, None] + np.arange(self.k)]  # each has its k old places, so k follow
        self.score[mine], self.no[mine], self.id[mine] = s[take], n[take], i[take]
        self.least[mine] = np.maximum(self.least[mine], self.score[mine, -1])


class Shard:
    """Postings cut at the borders of document blocks, with the best impact of every piece."""

    def __init__(self, row: dict, mean: float):
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.no = np.array([i is None for i in row["ids"]], bool)
        length = np.frombuffer(row["length"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.doc = np.frombuffer(row["doc"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tf"], np.int32).astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(mean, 1e-9)))[self.doc])
        self.blocks = max(1, -(-len(self.ids) // BLOCK_DOCS))
        wide = self.blocks * BLOCK_DOCS
        # Terms in many of the documents as columns of a matrix, with their best impact in each block.
        n = np.diff(self.offsets)
        often = np.flatnonzero(n >= max(2, wide // FREQUENT))
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((wide, len(often)))
        for r, t in enumerate(often):
            mine = slice(self.offsets[t], self.offsets[t + 1])
            self.dense[self.doc[mine], r] = self.impact[mine]
        self.best = self.dense.reshape(self.blocks, BLOCK_DOCS, len(often)).max(1).T
        self.single = np.ascontiguousarray(self.dense.T, np.float32)
        #: Blocks of queries that were pivots, and documents that were scored in full.
        self.scored = self.full = 0

    def top(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, best: Best, at: int) -> None:
        """Adds the hits of a batch of queries, numbered from 0 (from `at` in best), with a weight for each (query, term).

        What a query's rare terms give to each document, plus the sum of the best impact
        that each frequent term has in a block, bounds every document of the block. A
        query's cursors move on, in document order, to the next pivot: the next block
        whose bound reaches the query's k-th score, which rises with what the pivots
        hold. (The bound over whole postings lists, by which plain WAND finds pivots, is
        never less than that of the block, so the block's alone decides.) Frequent terms
        are added in single precision first: as all terms are positive, the error is
        below (terms + 8) / 2^24 of their sum, and only documents that may reach the k-th
        score within it are scored in full.
        """
        row, wide = self.row[term], self.blocks * BLOCK_DOCS
        rare = np.flatnonzero(row < 0)
        start = self.offsets[term[rare]]
        n = self.offsets[term[rare] + 1] - start
        post = np.arange(n.sum())
        post += np.repeat(start - (np.cumsum(n) - n), n)
        value = self.impact[post]
        value *= np.repeat(weight[rare], n)
        place = self.doc[post]
        place += np.repeat(query[rare] * wide, n)
        exact = np.bincount(place, value, queries * wide).reshape(queries, wide)
        w = np.zeros((queries, len(self.single)))
        often = row >= 0
        w[query[often], row[often]] = weight[often]
        light = w.astype(np.float32)
        slack = 1 + (len(self.single) + 8) * 2.0**-23
        bound = w @ self.best + exact.reshape(queries, self.blocks, BLOCK_DOCS).max(2)
        least = best.least[at : at + queries]
        for stride in range(0, self.blocks, STRIDE):
            live = (bound[:, stride : stride + STRIDE] > 0) & (bound[:, stride : stride + STRIDE] + 2e-6 >= least[:, None])
            self.scored += int(live.sum())
            q = np.flatnonzero(live.any(1))
            if not len(q):
                continue
            here = slice(stride * BLOCK_DOCS, (stride + STRIDE) * BLOCK_DOCS)
            high = light[q] @ self.single[:, here] * slack + exact[q, here]
            floor = least[q]
            reach = (high > 0) & (high + 2e-6 >= floor[:, None])
            many = np.flatnonzero(reach.sum(1) > 4 * best.k)
            if len(many):  # the k-th of these documents is reached too, whatever the error
                kth = np.partition(high[many], -best.k, 1)[:, -best.k]
                floor[many] = np.maximum(floor[many], kth / slack**2 - 2e-6)
                reach[many] &= high[many] + 2e-6 >= floor[many, None]
            r, d = np.nonzero(reach)
            if not len(r):
                continue
            q, d = q[r], d + stride * BLOCK_DOCS
            self.full += len(q)
            scores = np.round(exact[q, d] + np.einsum("ij,ij->i", w[q], self.dense[d]), 6)
            keep = (scores > 0) & (scores >= np.round(least[q], 6))
            q, d, scores = q[keep], d[keep], scores[keep]
            if len(q):
                best.add(at + q, scores, self.no[d], self.ids[d])


def _hits(index: DataFrame, sent, k: int, mean: float) -> DataFrame:
    """query_id, doc_id, score: what the tasks' shards hold of each query's best k, k rows a query and task at most.

    sent: the broadcast queries, (ids, start) of each, the distinct terms, and (number, place of the term, weight) of their terms, by number. A task keeps its
    best over all its shards, so every shard starts from the scores of the ones before it.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, start, distinct, number, which, weight = sent.value
        best = Best(start, k)
        cut = np.searchsorted(number, np.arange(0, len(qid) + BATCH, BATCH))
        for batch in rows:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], mean)
                if not len(shard.terms) or not len(distinct):
                    continue
                at = np.minimum(np.searchsorted(shard.terms, distinct), len(shard.terms) - 1)
                place = np.where(shard.terms[at] == distinct, at, -1)
                for j, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    at = place[which[a:b]]
                    have = np.flatnonzero(at >= 0)
                    if len(have):
                        shard.top(number[a:b][have] - np.int64(j * BATCH), at[have], weight[a:b][have], min(BATCH, len(qid) - j * BATCH), best, j * BATCH)
        q, place = np.nonzero(best.score > 0)
        ids = pa.array(best.id[q, place], mask=best.no[q, place] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(qid[q]), ids, pa.array(best.score[q, place])], ["query_id", "doc_id", "score"])

    return index.drop("number").mapInArrow(run, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = K, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the best k documents for each query (doc_id, text)."""
    spark = docs.sparkSession
    given = index
    if given is None:
        with batches(spark, SENT):
            index = staged(build_index(docs), "search-index", **WIDE)
    own = columns(queries, doc_id="long", text="string").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    with batches(spark, SENT):
        terms = staged(query_terms(own), "search-queries").withColumn("n", F.size("terms"))
    n, mean, df = statistics(index, terms)
    # Queries in blocks: a running count of terms, over partitions and then within each.
    weighted = terms.where("n > 0").select("query_id", F.posexplode("terms").alias("i", "term"), "counts", F.xxhash64("query_id").alias("h"))
    weighted = weighted.withColumn("count", F.col("counts")[F.col("i")]).join(df.hint("merge"), "term")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    total = terms.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // QUERY_TERMS))
    weighted = staged(weighted.select("query_id", "term", (idf * F.col("count")).alias("weight"), F.pmod("h", F.lit(blocks)).alias("part")), "search-weights")
    sampled = index.count() >= 2 * SAMPLED
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    found = []
    for part in range(blocks):
        own = weighted.where(F.col("part") == part).select("query_id", "term", "weight").orderBy("query_id", "term").toArrow()
        qid = own.column("query_id").to_numpy()
        ids, number = np.unique(qid, return_inverse=True)
        distinct, which = np.unique(own.column("term").to_numpy().view(np.uint64), return_inverse=True)
        rest = (distinct, number.astype(np.int32), which.astype(np.int32), own.column("weight").to_numpy())
        start = np.zeros(len(ids))
        if sampled:
            # The k-th scores among a share of the shards are reached by all: the other tasks send little below them.
            sent = spark.sparkContext.broadcast((ids, start, *rest))
            with batches(spark, 1):
                first = staged(_hits(index.where(F.col("number") % SAMPLED == 0), sent, k, mean), "search-sample")
            sent.destroy()
            for r in ranked(first).where(F.col("rank") == k).select("query_id", "score").collect():
                start[np.searchsorted(ids, r["query_id"])] = r["score"]
            unstage(first)
        sent = spark.sparkContext.broadcast((ids, start, *rest))
        with batches(spark, 1):
            found.append(staged(_hits(index, sent, k, mean), "search-hits"))
        sent.destroy()
    for x in (terms, df, weighted, *([index] if given is None else [])):
        unstage(x)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return ranked(hits).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0))


SQL = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT term, ln(1 + (s.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, s GROUP BY term, s.n),
r AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         round(sum(q.tf * f.idf * t.tf * {K1 + 1} / (t.tf + {K1} * (1 - {B} + {B} * l.len / s.mean))), 6) AS score
  FROM t q JOIN f USING (term) JOIN t ON t.term = q.term JOIN l ON l.doc_id = t.doc_id, s
  WHERE q.doc_id % {EVERY} = 0
  GROUP BY q.doc_id, t.doc_id)
SELECT query_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
WHERE rank <= {K}
"""
