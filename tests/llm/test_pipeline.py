"""The pipeline: stages act on all rows of the one before, and planted cases are caught."""

import random

import pytest

import corpus_pipeline
from heliograph.llm import registry
from heliograph.runtime import staged


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    w = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(w) for _ in range(n))
    passage = text(60)
    rows = [[i, "\n".join(text(60) for _ in range(3)), "en", f"s{i % 7}", 0] for i in range(210)]
    for i in range(0, 30, 3):
        rows[i][1] += "\n" + passage
    for i in range(40, 45):
        rows[i][1] = rows[40][1]  # exact copies
    labels = []
    for i in range(100, 210):
        toxic = i % 2
        if toxic:
            for _ in range(12):
                rows[i][1] = rows[i][1].replace(r.choice(w), r.choice(["vile", "foul"])) + " vile foul"
        labels.append((i, 1, toxic))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, corpus):
    d, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = seen[name] = staged(out, "test")
    assert seen["toxicity"].where("text like '%vile%'").count() == 0
    assert seen["toxicity"].where("doc_id < 100").count() == 100
    assert seen["line_dedup"].where(f"text like '%{passage}%'").count() == 1
    assert seen["simhash"].where("doc_id between 40 and 44").count() == 1
    assert seen["mixing"].count() > 0
    full = corpus_pipeline.run(spark, d)
    assert full.count() == seen["mixing"].count() and "ids" in full.columns


def test_registry():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
