"""The ten operators: brute force, exact round trips, held-out accuracy, and the odd cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from heliograph.llm import bpe, context_tree, cotraining, language_id, line_dedup, mixing, quality_rules, search, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    w = [f"w{i}" for i in range(300)]
    base = sentence(r, w, 120)
    rows = [
        (1, base, "en", "a", len(base)),
        (1, base, "en", "a", len(base)),
        (2, base, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "de", "b", 0),
        (5, " \t\n\x0b ", "de", "b", 5),
        (6, sentence(r, w, 30_000), "en", "c", None),
        (None, "x y z", "en", "a", 5),
        (7, "é   ÀÉ |#|", "fr", "b", 9),
        (8, base + " tail", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_score", "_text", "_drop", "_drop_id", "_kept", "_mix_id", "_mix_source", "_mix_copies", "_node", "_key", "_nth", "_best_key", "_best_node", "a.b", "score", "size", "copies", "rank", "h", "w", "t", "key", "bucket", "drop", "fp", "component_id", "held_out", "toxic", "quality", "v"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def labels_of(spark, docs, column):
    return docs.where("doc_id is not null").select("doc_id").distinct().withColumn(column, (F.col("doc_id") % 2).cast("int"))


def test_no_operator_breaks_on_odd_rows(spark, odd):
    empty = odd.where("false")
    q, t = labels_of(spark, odd, "quality"), labels_of(spark, odd, "toxic")
    for d, n in ((odd, 10), (empty, 0)):
        assert quality_rules.judge(d, q).count() == n
        assert toxicity.score(d, t).where("_score between 0 and 1").count() == n
        assert bpe.encode(d).count() == n
        assert simhash.groups(d).count() == n
        assert context_tree.score(d).where("score < 0").count() == n
        assert cotraining.score(d, q).where("score between 0 and 1").count() == n
        assert mixing.copies(d).count() == n
        assert line_dedup.dedup_lines(d).columns == d.columns
        assert line_dedup.dedup_lines(d).count() == n
        assert language_id.identify(d).where("score between 0 and 1").count() == n
        assert search.search(d, d.where("doc_id in (1, 3)")).count() in (0, 5)
        assert mixing.mix(d).columns == d.columns
        assert simhash.near_dedup(d).columns == d.columns
        assert simhash.near_dedup(d).count() == (5 if n else 0)
        assert mixing.mix(d.drop("source")).count() == mixing.copies(d.drop("source")).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    none = q.where("false")
    assert toxicity.score(odd.select("doc_id", "text"), none.withColumnRenamed("quality", "toxic")).where("_score <> 0").count() == 0
    assert cotraining.score(odd, none).where("score <> 1").count() == 0


def test_quality_statistics(spark):
    def brute(t):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        c = Counter(grams)
        covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(words), sum(map(len, words)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    r = random.Random(1)
    texts = ["", "a b c a b c", "a a a a", "x\n\nx\ny | z\nx", "  é b #"] + [("\n" if k % 2 else " ").join(sentence(r, "abcde", r.randint(0, 30)) for _ in range(3)) for k in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality_rules.statistics(d).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute(texts[x["doc_id"]])


def test_rules_are_learned(spark):
    r = random.Random(2)
    w = [f"word{i}" for i in range(500)]
    rows = [(i, sentence(r, w, 80).upper() + "!!" if i % 4 == 0 else sentence(r, w, 80), int(i % 4 > 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    j = quality_rules.judge(d.drop("quality"), d.drop("text")).join(d.select("doc_id", "quality"), "doc_id")
    assert j.where("kept <> (quality = 1)").count() == 0 and j.where("rule > 0").count() == 100


def test_toxicity_held_out(spark):
    r = random.Random(3)
    w = [f"word{i}" for i in range(2000)]
    bad = ["vile", "rotten", "foul", "nasty"]
    rows = []
    for i in range(800):
        t = [r.choice(w) for _ in range(120)]
        if i % 3 == 0:
            for _ in range(8):
                t[r.randrange(len(t))] = r.choice(bad)
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    s = toxicity.score(d.drop("toxic"), d.drop("text")).join(d.select("doc_id", "toxic"), "doc_id").collect()
    held = [x for x in s if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert sum((x["_score"] >= 0.5) == bool(x["toxic"]) for x in held) >= 0.95 * len(held)


def test_bpe_is_exact(spark):
    raw, pattern = bpe.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["", " ", "don't  stop\n\n\t x", "<|endoftext|>", "a" * 1000, "é" * 400, "xyzw" * 63, "!?" * 300] + ["".join(chr(r.choice((32, 10, r.randrange(33, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F600)))) for _ in range(r.randint(1, 300))) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for x in bpe.encode(d).collect():
        t = texts[x["doc_id"]] if x["doc_id"] < len(texts) else ""
        ids = enc.encode_ordinary(t)
        assert x["ids"] == ids and x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_simhash_against_all_pairs(spark):
    r = random.Random(6)
    w = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = sentence(r, w, 200).split()
        for _ in range(6):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(200)] = "edit"
            texts.append(" ".join(t))
    texts += ["", "one", "one two", "A B c", "a b c"]
    fp = {}
    for i, t in enumerate(texts):
        ws = t.encode().lower().split()
        sh = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        c = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        fp[i] = sum(1 << b for b in range(64) if 2 * c[b] > len(sh))
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i in fp:
            root[i] = min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
            root[i] = root[root[i]]
        if before == root:
            break
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (2000, 2):
        for x in simhash.groups(d, hot=hot).collect():
            assert x["fp"] & (2**64 - 1) == fp[x["doc_id"]] and x["component_id"] == root[x["doc_id"]]


def test_thresholds_cover_all_pairs():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (500, 64))
    for distance in (2, 3, 5):
        p = simhash.plan(500, (x.T @ x).astype(float), distance)
        assert sum(t + 1 for _, t in p) == distance + 1


def test_context_tree_is_a_distribution():
    keys = context_tree.grams([b"abracadabra\n", b"abra cadabra\n"])
    k, n = np.unique(keys, return_counts=True)
    tree = context_tree.Tree(k, n.astype(np.int64))
    pairs = Counter(int(x) & 0xFFFF for x in keys)
    add, share, bare = context_tree.short_orders(dict(pairs), tree.weighted, tree.contexts[2])
    for ctx in (b"\n\n\nab", b"zzzzz", b"zzzab", b"xcada"):
        q = np.array([int.from_bytes(ctx + bytes([y]), "big") for y in range(256)], np.uint64)
        p, y = tree.predict(q), np.arange(256)
        assert np.where(p > 0, add[ctx[-1], y] + share[ctx[-1]] * p, bare[ctx[-1], y]).sum() == pytest.approx(1)


def test_block_probability_is_sequential():
    """The closed form of a context's block probability against adding one byte at a time."""
    r, seen, log_p = random.Random(8), [], 0.0
    for _ in range(60):
        b = r.choice(b"abcz")
        for bit in range(8):
            same = [s for s in seen if s >> (8 - bit) == b >> (8 - bit)]
            ones = sum(s >> (7 - bit) & 1 for s in same)
            k = ones if b >> (7 - bit) & 1 else len(same) - ones
            log_p += math.log((k + 0.5) / (len(same) + 1))
        seen.append(b)
    k, n = np.unique(np.array(seen, np.uint64), return_counts=True)
    assert context_tree.estimates(k, n.astype(np.int64))[2][0] == pytest.approx(log_p)


def test_scores_and_base(spark):
    r = random.Random(9)
    w = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(60)]
    texts = [sentence(r, w, 50) for _ in range(200)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*(t or "").lower().split(), "\n"])
    total, distinct = sum(train.values()), len(train)
    one = {x["doc_id"]: x for x in context_tree.score(d).collect()}
    for i, t in enumerate(texts):
        toks = [*(t or "").lower().split(), "\n"]
        assert one[i]["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in toks))
        assert (one[i]["n_tokens"], one[i]["n_known"], one[i]["train_tokens"]) == (len(toks), sum(train[x] > 0 for x in toks), total)
    # Cut into many shards, the scores are the same.
    for x in context_tree.score(d, shard=500).collect():
        assert (x["n_known"], x["score"], x["base_score"]) == (one[x["doc_id"]]["n_known"], pytest.approx(one[x["doc_id"]]["score"]), pytest.approx(one[x["doc_id"]]["base_score"]))


def test_cotraining_held_out(spark):
    r = random.Random(10)
    w = [f"word{i}" for i in range(800)]
    rows = []
    for i in range(900):
        good = i % 3 > 0
        t = sentence(r, w, 60) if good else sentence(r, w[:20], 60).upper() + " !!"
        rows.append((i, t, "en", f"s{r.randrange(3) + (0 if good else 2)}", len(t), int(good)))
    d = spark.createDataFrame(rows, DOCS + ", quality int")
    s = cotraining.score(d.drop("quality"), d.where("doc_id % 2 = 0").select("doc_id", "quality")).join(d.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert sum((x["score"] >= 0.5) == bool(x["quality"]) for x in s) >= 0.95 * len(s)


def test_cotraining_exchanges_labels_of_all_rows(spark):
    """A round scores every unlabelled row; each view teaches the other what it is sure of, and nothing else."""
    r = random.Random(16)
    w = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, sentence(r, w, 30) if good else sentence(r, w[:5], 30).upper(), "en", "good" if good else "bad", 100, int(good)))
    d = spark.createDataFrame(rows, DOCS + ", quality int")
    get = {x[0]: (cotraining.content(x[1]), cotraining.metadata(x[3], x[2], x[4])) for x in rows}
    views = cotraining.Views([(*get[i], rows[i][5], i % 4 > 0) for i in range(120)])
    p = {v: {i: float(cotraining._sigmoid(cotraining.Sparse([get[i][v]]).dot(views.w[v][:-1]) + views.w[v][-1])[0]) for i in range(120, 600)} for v in (0, 1)}
    n = cotraining.exchange(views, d.drop("quality"), d.where("doc_id < 120"), 2 / 3, "x", 10**6)
    for v in (0, 1):
        assert set(views.taught[1 - v]) == {i for i, x in p[v].items() if x >= 0.9 or x <= 0.1}
        assert all(label == (p[v][i] > 0.5) for i, (_, _, label) in views.taught[1 - v].items())
    assert n == sum(map(len, views.taught)) > 0


def test_mixing_targets(spark):
    r = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 40))), "x", r.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:  # reshare by weight until none is above its cap
        free = [s for s in order if s not in full]
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 3 * size[s] for s in full}
        above = {s for s in free if target[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    c = mixing.copies(d).collect()
    taken = Counter()
    for x in c:
        assert x["target"] == pytest.approx(target[x["source"]]) and 0 <= x["copies"] <= 3
        taken[x["source"]] += x["copies"] * x["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 40
    assert sorted((x["doc_id"], x["copies"]) for x in mixing.copies(d).collect()) == sorted((x["doc_id"], x["copies"]) for x in c)
    assert mixing.mix(d).count() == sum(x["copies"] for x in c)


def test_search_against_all_scores(spark, monkeypatch):
    r = random.Random(12)
    w = [f"t{int(r.paretovariate(0.7))}" for _ in range(3000)]
    texts = [sentence(r, w, r.randint(0, 60)) for _ in range(300)] + ["", None]
    texts[17] = texts[3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [Counter((t or "").lower().split()) for t in texts]
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    want = {}
    for q in range(0, 300, 20):
        score = {}
        for i, b in enumerate(bags):
            s = sum(c * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, c in bags[q].items() if b[t])
            if s > 0:
                score[i] = round(s, 6)
        want[q] = [i for i, _ in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]]
    for shard, terms, block, sampled in ((4096, 2_000_000, 64, 16), (4096, 100, 8, 16), (40, 2_000_000, 4, 2), (16, 300, 2, 3)):
        for k, v in (("SHARD_DOCS", shard), ("QUERY_TERMS", terms), ("BLOCK_DOCS", block), ("SAMPLED", sampled), ("BATCH", 7)):
            monkeypatch.setattr(search, k, v)
        got = search.search(d, d.where("doc_id < 300 and doc_id % 20 = 0")).orderBy("query_id", "rank").collect()
        for q in want:
            assert [x["doc_id"] for x in got if x["query_id"] == q] == want[q]


def test_pivots_pass_over_blocks(monkeypatch):
    """Blocks that can't hold a hit are not scored, and what is found is what scoring all of them finds."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    r = random.Random(14)
    docs = [search.term_counts(" ".join(["common", *(["rare"] * 5 if i < 12 else []), *(f"w{r.randrange(50)}" for _ in range(20))])) for i in range(400)]
    t, tf = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    doc = np.repeat(np.arange(400, dtype=np.int32), [len(d[0]) for d in docs])
    order = np.argsort(t, kind="stable")
    terms, first = np.unique(t[order], return_index=True)
    row = {"number": 0, "ids": list(range(400)), "length": np.array([d[1].sum() for d in docs], np.int64).tobytes(), "terms": terms.tobytes(), "offsets": np.append(first, len(t)).astype(np.int64).tobytes(), "doc": doc[order].tobytes(), "tf": tf[order].astype(np.int32).tobytes()}
    shard = search.Shard(row, 22.0)
    query, weights = search.term_counts("rare common")[0], np.array([3.0, 0.01])
    at = np.searchsorted(terms, query)
    rare = search.term_counts("rare")[0][0]
    w = np.where(query == rare, *weights)
    best = search.Best(np.zeros(1), 10)
    shard.top(np.zeros(2, np.int64), at, w, 1, best, 0)
    assert shard.scored < 50 // 4
    scores = np.zeros(400)
    for term, x in zip(at, w):
        mine = slice(shard.offsets[term], shard.offsets[term + 1])
        scores[shard.doc[mine]] += shard.impact[mine] * x
    assert best.id[0].tolist() == sorted(range(400), key=lambda i: (-round(scores[i], 6), i))[:10]


def test_toxicity_models_are_distributions():
    """Every context's probabilities sum to 1 in both classes, and texts are scored as by hand."""
    r = random.Random(15)
    w = [f"w{i}" for i in range(200)]
    texts = [[x for _ in range(30) for x in (r.choice(w).encode(), *([b"vile"] * (i % 2)))] for i in range(80)]
    m = toxicity.Comparison([[x if r.random() < 0.9 or x == b"vile" else b"own%d" % i for x in t] for i, t in enumerate(texts)], [i % 2 for i in range(80)])
    lookup = lambda b, x: m.pairs.find(np.array([b * m.size + x], np.uint64))[0]

    def log_p(y, b, x):
        at = lookup(b, x)
        return m.pair[y, at] if at >= 0 else m.back[y, b] + m.word[y, x]

    assert m.pair.shape[1] > 100
    for b in range(0, m.size, 29):
        for y in (0, 1):
            assert sum(math.exp(log_p(y, b, x)) for x in range(m.size)) == pytest.approx(1)
    for t in ([], [b"vile"], texts[3], [b"never", b"seen", b"w1"]):
        x = [toxicity.END, *(m.vocabulary.get(q, toxicity.UNKNOWN) for q in t), toxicity.END]
        for y in (0, 1):
            assert m.log_likelihoods([t])[0, y] == pytest.approx(sum(log_p(y, a, b) for a, b in zip(x, x[1:])) / (len(t) + 1))
    assert m.word[1, m.vocabulary[b"vile"]] - m.word[0, m.vocabulary[b"vile"]] > toxicity.TIE
    assert m.differences([[b"vile"] * 2 + texts[0][:8]])[0] > m.differences([texts[0][:10]])[0]


def test_line_sketches_spare_exact_rows(spark):
    """Only lines near the threshold have their sites counted exactly."""
    rows = [(i, f"everywhere\nown {i}\nfew {i // 3}", f"s{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.spread(d).withColumn("h", F.col("h1")).collect()
    assert len(got) == 21 and sum(x["near"] for x in got) == 20  # the line of 60 sites is sure, the 60 own lines are out
    kept = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(d).collect()}
    assert kept[0] == rows[0][1] and kept[3] == "own 3\nfew 1" and kept[4] == "own 4"


def test_line_dedup(spark):
    shared, near = "a line on many sites", "a line on two sites"
    rows = [(i, f"own {i}\n{shared}\n\n{near if i < 2 else 'own too'}", "en", f"s{i}", 1) for i in range(5)] + [(9, f"{shared}\n{shared}", "en", "s1", None)]
    d = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(d).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_chars"] == 1
    assert got[1]["text"] == f"own 1\n\n{near}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[9]["text"] == ""
    left = {x["doc_id"] for x in line_dedup.dedup_lines(d, drop_emptied=True).collect()}
    assert left == {0, 1, 2, 3, 4}


def test_language_network_gradients():
    net = language_id.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(1)
    x, mask, y = r.integers(1, 255, (3, 64)).astype(np.uint8), np.ones((3, 64), np.float32), np.array([0, 1, 2])
    g = net.gradients(x, mask, y)
    loss = lambda: -np.mean(np.log(net.probabilities(net.forward(x))[:, np.arange(3), y]))
    for k, i in (("u", (0, 2, 5)), ("v", (1, 3, 2)), ("b", (1,)), ("e", (0, int(x[0, 4]), 20))):
        old = net.w[k][i]
        net.w[k][i] = old + 3e-3
        up = loss()
        net.w[k][i] = old - 3e-3
        down = loss()
        net.w[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 6e-3, rel=1e-2, abs=1e-5)


def test_language_held_out(spark):
    r = random.Random(13)
    parts = {"en": ["the", "th", "ing", "and", "tion"], "de": ["sch", "ung", "und", "ei", "cht"], "fr": ["eau", "les", "oi", "que", "ère"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(80)), k, "s", 1) for i in range(300) for k in [sorted(parts)[i % 3]]]
    odd = ["12 34 !!", None, "½ ² ³", "Ⅳ", "12", "_ - _"]
    rows += [(1000 + i, t, "en", "s", 1) for i, t in enumerate(odd)]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = [x for x in rows[:300] if got[x[0]]["held_out"]]
    assert sum(got[x[0]]["lang_pred"] == x[2] for x in held) >= 0.95 * len(held)
    assert {got[1000 + i]["lang_pred"] for i in range(len(odd))} == {"und"}
