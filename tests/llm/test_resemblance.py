"""The pipeline's near-duplicate stage against brute force."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from heliograph import runtime
from heliograph.llm import resemblance, simhash

SCHEMA = "doc_id long, text string"


def edited(r, words, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = r.choice(words)
    return " ".join(w)


@pytest.mark.parametrize("common", [2, 10**9])
def test_all_similar_pairs(spark, monkeypatch, common):
    """Near copies far beyond 3 bits, chains, a family and a common passage, whatever the order of shingles."""
    monkeypatch.setattr(resemblance, "COMMON", common)
    r = random.Random(3)
    w = [f"word{i}" for i in range(4000)]
    make = lambda n: " ".join(r.choice(w) for _ in range(n))
    rows = [make(r.randint(150, 400)) for _ in range(40)]
    rows += [edited(r, w, rows[i], r.randint(1, 9)) for i in range(30)]
    for _ in range(4):
        rows.append(edited(r, w, rows[-1], 4))
    rows += [edited(r, w, rows[0], r.randint(1, 6)) for _ in range(40)]
    passage = make(40)
    rows += [f"{make(r.randint(1, 60))} {passage}" for _ in range(30)] + [passage, passage + " one", "", " \n", None, "a b", "A  B", "a b c"]
    sets = [set(resemblance.shingles((t or "").encode()).tolist()) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert 60 < len(set(root)) < len(rows) - 50
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("hot", [10**9, 0])
def test_surviving_rows_of_odd_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(resemblance, "HOT", hot)
    dedup = simhash.near_dedup
    r = random.Random(8)
    w = [f"word{i}" for i in range(4000)]
    a, b, c, d, e = (" ".join(r.choice(w) for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (1, b), (2, c), (2, d), (3, e), (4, "x " + d), (4, e), (5, "y " + c)]
    near = [(2, c), (2, d), (1, b), (3, e), (None, a)]
    assert sorted(map(repr, (tuple(x) for x in dedup(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(repr, near))


def test_parities_bound_the_difference():
    """Never more places than members, for sets of any two sizes, and nearly always enough to rule unlike sets out."""
    r = np.random.default_rng(5)
    ruled = tried = 0
    for n in (1, 2, 63, 64, 65, 200, 1000, 5000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            for m in (n, max(1, n * 4 // 5), 3 * n):
                a = np.unique(r.integers(-(2**63), 2**63, n))
                b = np.unique(np.concatenate([a[: int(share * min(n, m))], r.integers(-(2**63), 2**63, m - int(share * min(n, m)))]))
                differ = resemblance.differ(resemblance.parities(a), resemblance.parities(b))
                exact = len(np.setxor1d(a, b))
                assert differ <= exact and (differ - exact) % 2 == 0
                if n >= 200 and share <= 0.6:
                    tried, ruled = tried + 1, ruled + (9 * differ > len(a) + len(b))
    assert ruled == tried


@pytest.mark.parametrize("sent", [10**6, -1])
def test_only_likely_pairs_move_their_sets(spark, monkeypatch, sent):
    """Texts that share a rare passage, but little else, meet; their whole sets stay where they are, and no large table outlives its use."""
    monkeypatch.setattr(resemblance, "SENT", sent)
    monkeypatch.setattr(resemblance, "COMMON", 10**9)
    moved = []

    def staged(df, name):
        out = runtime.staged(df, name)
        if name == "similar-sets":
            moved.append(out.count())
        return out

    monkeypatch.setattr(resemblance, "staged", staged)
    r = random.Random(4)
    w = [f"word{i}" for i in range(4000)]
    passage = " ".join(r.choice(w) for _ in range(60))
    rows = [f"{passage} " + " ".join(r.choice(w) for _ in range(150)) for _ in range(60)]
    rows += [edited(r, w, rows[0], 2)]
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    folder = runtime.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert sorted(x["doc_id"] for x in simhash.near_dedup(docs).collect()) == list(range(60))
    assert moved[0] == 2 and sum(moved) <= 4
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"similar-prefix", "similar-met", "similar-placed", "similar-open", "similar-sets"}


def test_shuffle_files_go_with_a_staged_write(spark):
    """The session's setting stays as it was, and the write leaves no shuffle files to a later collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    seen = []
    with runtime.tidy(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key, None) == before
    assert runtime.staged(spark.range(1000).repartition(7, "id"), "tidy").count() == 1000
