"""What a scorer of op5 takes while it is built, and what it keeps."""

import tracemalloc

import numpy as np

from heliograph.llm import context_tree


def test_building_a_tree_takes_little_besides(monkeypatch):
    r = np.random.default_rng(2)
    text = r.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 400_000).tobytes()
    keys, n = np.unique(context_tree.grams([text]), return_counts=True)
    trims = []
    monkeypatch.setattr(context_tree, "trim", lambda: trims.append(1), raising=False)
    zeros = np.zeros((256, 256)), np.zeros(256), np.zeros((256, 256))
    tracemalloc.start()
    try:
        scorer = context_tree.Scorer(((keys, n), (np.sort(keys), n), zeros, 1, 1, 0, 1, None))
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(trims) == 1
    assert peak < 18 * keys.nbytes
    assert (scorer.tree.predict(keys[:1000]) > 0).all()
