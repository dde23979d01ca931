"""The shard's scoring against all products in double precision."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from heliograph import runtime
from heliograph.llm import search


def shard(r, docs, vocabulary):
    """A shard of random texts with frequent and rare terms, many of them repeated."""
    p = 1 / np.arange(1, vocabulary + 1)
    texts = [r.choice(vocabulary, r.integers(0, 300), p=p / p.sum()) for _ in range(docs)]
    for i in range(0, docs - 1, 3):
        texts[i + 1] = texts[i]  # ties
    parts = [np.unique(t, return_counts=True) for t in texts]
    t = np.concatenate([a for a, _ in parts]).astype(np.uint64)
    tf = np.concatenate([c for _, c in parts]).astype(np.int32)
    doc = np.repeat(np.arange(docs, dtype=np.int32), [len(a) for a, _ in parts])
    order = np.argsort(t, kind="stable")
    t, tf, doc = t[order], tf[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    length = np.array([len(x) for x in texts], np.int64)
    row = {"ids": list(range(docs)), "length": length.tobytes(), "terms": t[first].tobytes(), "offsets": np.append(first, len(t)).astype(np.int64).tobytes(), "doc": doc.tobytes(), "tf": tf.tobytes()}
    return search.Shard(row, float(length.mean())), parts


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_few_documents_are_scored_in_full(scale):
    r = np.random.default_rng(11)
    docs, queries, k = 1500, 40, 10
    s, parts = shard(r, docs, 3000)
    assert 0 < s.best.shape[0] < len(s.terms)
    number, term, weight, want = [], [], [], []
    for q in range(queries):
        a = parts[q * 7 + 1][0].astype(np.uint64)
        w = scale * r.random(len(a))
        at = np.searchsorted(s.terms, a)
        number, term, weight = number + [q] * len(a), term + at.tolist(), weight + w.tolist()
        score = np.zeros(docs)
        for x, y in zip(at, w):
            mine = slice(s.offsets[x], s.offsets[x + 1])
            np.add.at(score, s.doc[mine], y * s.impact[mine])
        score = np.round(score, 6)
        order = np.lexsort((np.arange(docs), -score))[:k]
        want.append([(int(i), float(score[i])) for i in order if score[i] > 0])
    best = search.Best(np.zeros(queries), k)
    s.top(np.array(number), np.array(term), np.array(weight), queries, best, 0)
    for q in range(queries):
        got = [(int(i), float(x)) for i, x in zip(best.id[q], best.score[q]) if x > 0]
        assert [x for _, x in got] == pytest.approx([x for _, x in want[q]], abs=2e-6, rel=1e-12)
        if scale >= 1:
            assert [i for i, _ in got] == [i for i, _ in want[q]]
    assert s.full < queries * docs / 10


def test_shards_travel_one_by_one(spark, monkeypatch):
    """Whatever their number in a file: pages, row groups and batches hold a few shards at most."""
    monkeypatch.setattr(search, "SHARD_DOCS", 64)
    d = spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 30), i -> concat('w', pmod(hash(id, i), 5000)))) AS text").coalesce(1)
    index = runtime.staged(search.build_index(d), "index", **runtime.WIDE | {"parquet.block.size": 100_000})
    assert index.count() == 32
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 8

    seen = {}

    def staged(df, name, **options):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        return runtime.staged(df, name, **options)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(search, "staged", staged)
    got = search.search(d, d.where("doc_id % 100 = 0"))
    assert got.where("rank = 1 and query_id = doc_id").count() == 20
    assert seen["search-index"][0] == search.SENT and seen["search-df"] == seen["search-hits"] == (1, 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
