"""The query sets of searches and scores grow with the table."""

from functools import reduce
from operator import add

import pytest

from heliograph import catalog

WORDS = ["red green blue", "green blue blue", "one two", "two three four five"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    vec = [(i, i % 3, [float((i * k) % 17) for k in range(1, 9)]) for i in range(350)]
    spark.createDataFrame(vec, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, WORDS[i % 4]) for i in range(90)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ["local_subspaces", "knn_euclidean_every", "knn_vote_every"])
def test_searches(spark, sf, name):
    assert {r["query_idx"] for r in catalog.QUERIES[name](spark, sf).collect()} == {0, 100, 200, 300}


def test_bleu(spark, sf):
    got = {r["candidate"]: r["bleu"] for r in catalog.QUERIES["bleu_unigrams_every"](spark, sf).collect()}
    assert set(got) == set(range(90))
    # item 89 is "green blue blue", its reference item 0 "red green blue"
    assert got[89] == pytest.approx(2 / 3 * 2.718281828459045**0, abs=1e-9)


def test_means_on_a_threshold_are_the_same_in_any_order(spark, tmp_path):
    """The first user's purchases have the mean 47 exactly; in this order, sums of doubles come out below it."""
    values = [80.38, 55.08, 62.81, 21.73, 15.0]
    assert sum(round(v * 100) for v in values) == 47 * 100 * len(values) and reduce(add, values, 0.0) / len(values) < 47
    rows = [(i, u, "purchase", v) for u, vs in ((1, values), (2, values[::-1]), (3, [46.99]), (4, [float("nan")]), (5, [1e300, 1.0]), (6, [None])) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r["object_idx"]: r["v"] for r in catalog._named(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: -1, 4: 1, 5: 1, 6: 0}
