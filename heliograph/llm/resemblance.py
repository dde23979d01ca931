"""Near-duplicate groups by the resemblance of word-shingle sets: all pairs, exactly.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity
of 0.8 or more, and the groups are the connected components of the links.

The search is a prefix filter, which misses no pair: with all shingles in one
order, the first n - ceil(0.8 n) + 1 of a text with n hold one that a similar
text has among its own first ones. At the first shingle they share, the places
bound what they can share at all, and that drops most of the pairs that meet.
Any order is right; shingles that a sample of texts repeats come last, so that
common passages are no text's prefix unless it has little else.

Pairs that meet are first held against a bound: the parities of the sets' hashes,
in as many bits as the larger power of two, differ in no more places than the
sets do in members, so pairs whose parities differ too often are not similar.
What is left is verified on the whole sets. There are two rounds. First every text
meets only the least text that has a prefix shingle of its own, which joins a
family of copies at a cost that is linear in it; then texts meet all others of
the shingle that are not of their component yet.

Defined results: words are runs without ASCII white space, in lower case (ASCII
letters); a text of fewer than five words is one shingle, and texts without
words (null too) are alike; equal texts are one node, named by a 64-bit hash; a
group is named and kept by its least id, null last, and by the least node among
rows that share the id; only doc_id and text are read for the decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..graph import components
from ..runtime import staged, tidy, unstage
from .text import columns, fresh, own, value, whole

SEED = 42
SIZE = 5
#: Texts whose shingles are counted for the order, and how many of them make a shingle common.
SAMPLE, COMMON, MOST = 20_000, 3, 500_000
#: Shingles of so many texts of the sample are too frequent for one task.
HOT = 200
#: 0.8 as a fraction, so that the tests are in whole numbers: |a and b| * 9 >= 4 * (|a| + |b|).
_PART, _OF = 4, 5
_ROWS = 256
#: So many nodes at most are sent to the tasks that look for their texts; more are joined.
SENT = 1_000_000


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h.view(np.int64))


def node(text: Column) -> Column:
    """What names a text: equal texts are one node."""
    return F.xxhash64(whole(text))


def parities(s: np.ndarray) -> bytes:
    """Whether an even or odd number of hashes have the same low bits: 64 bits, or as many as the next power of two."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """In how many places two parities differ: at most the number of hashes that only one of the sets has."""
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a), int.from_bytes(b[: len(a)])
    for k in range(len(a), len(b), len(a)):  # parities of fewer low bits are sums of those of more
        y ^= int.from_bytes(b[k : k + len(a)])
    return (x ^ y).bit_count()


def _sets(docs: DataFrame, size: int, common: tuple[np.ndarray, np.ndarray] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id, node, n, set, bits: the shingles of every row, or of the nodes `wanted` (sorted); with `common` (hash, count) only the prefix, in order, and the parities of all."""
    sent = docs.sparkSession.sparkContext.broadcast((common, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, wanted = sent.value
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(1).to_numpy(), wanted)))
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                n, out, bits = [], [], []
                for t in b.column(2).cast(pa.binary()):
                    s = shingles(t.as_py() or b"", size)
                    n.append(len(s))
                    bits.append(None if common is None else parities(s))
                    if common is not None:
                        if len(common[0]):
                            i = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
                            s = s[np.lexsort((s, np.where(common[0][i] == s, common[1][i], 0)))]
                        s = s[: len(s) - -(-_PART * len(s) // _OF) + 1]
                    out.append(s)
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out))), pa.array(bits, pa.binary())], ["doc_id", "node", "n", "set", "bits"])

    d = columns(docs, doc_id="long", text="string").select("doc_id", node(F.col("text")).alias("node"), "text")
    return d.mapInArrow(run, "doc_id long, node long, n long, set array<long>, bits binary")


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, with their counts; it only sets the order."""
    every = max(1, docs.count() // SAMPLE)
    some = columns(docs, doc_id="long", text="string")
    some = some.where(F.pmod(node(F.col("text")), F.lit(every)) == 0)
    c = _sets(some, size).select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    with tidy(docs.sparkSession):
        got = c.orderBy(F.desc("c"), "h").limit(MOST).orderBy("h").toArrow()
    return got.column("h").to_numpy(), got.column("c").to_numpy()


def _meet(a: str, b: str) -> Column:
    """Whether two texts that share a shingle at these places can be similar, if it is the first they share."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return left * (_PART + _OF) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * _PART


def _possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that their parities don't rule out; bits: node, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = (b.column(2).to_numpy() + b.column(3).to_numpy()).tolist()
            # shared * 9 >= 4 * n, where n - 2 * shared differ.
            keep = [(_PART + _OF) * differ(x, y) <= m * (_OF - _PART) for m, x, y in zip(n, b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, two = (bits.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv")
    both = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v")
    return both.select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(run, "u long, v long")


def _similar(docs: DataFrame, pairs: DataFrame, size: int, bits: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are similar on their whole sets."""
    pairs = staged(_possible(pairs, bits), "similar-possible")
    need = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "similar-need")
    d = columns(docs, doc_id="long", text="string").withColumn("node", node(F.col("text")))
    if need.count() <= SENT:
        sets = _sets(d, size, wanted=np.sort(need.toArrow().column("node").to_numpy()))
    else:
        sets = _sets(d.join(need.hint("merge"), "node", "left_semi"), size)
    sets = staged(sets.select("node", "set").dropDuplicates(["node"]), "similar-sets")
    one, two = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "uv")
    both = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v")
    shared = F.size(F.array_intersect("set_u", "set_v"))
    found = staged(both.where(shared * (_PART + _OF) >= (F.size("set_u") + F.size("set_v")) * _PART).select("u", "v"), "similar-links")
    for x in (pairs, need, sets):
        unstage(x)
    return found


def _with_hubs(p: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """p (h, node, n, at) to (h, x, hub) for the shingles that several texts hold: x is the row, hub the least of its shingle.

    Shingles that the sample holds often may stand in a third of all texts; their
    least row is an aggregate that is joined back, which AQE splits where it is
    skewed. All others meet in one window each.
    """
    hot = p.sparkSession.createDataFrame([(h,) for h in common[0][common[1] >= HOT].tolist()], "h long")
    x = F.struct("node", "n", "at")
    by = W.partitionBy("h")
    cold = p.join(F.broadcast(hot), "h", "left_anti")  # at most SAMPLE * shingles a text / HOT rows, MOST at the outside
    cold = cold.withColumns({"hub": F.min(x).over(by), "held": F.count("*").over(by)}).where("held > 1").select("h", x.alias("x"), "hub")
    warm = p.join(F.broadcast(hot), "h", "left_semi")
    hubs = warm.groupBy("h").agg(F.min(x).alias("hub"), F.count("*").alias("held")).where("held > 1").select("h", "hub")
    return cold.unionByName(warm.join(hubs.hint("merge"), "h").select("h", x.alias("x"), "hub"))


def links(docs: DataFrame, size: int = SIZE, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (u, v): links that connect all similar nodes.

    candidates (u, v with u > v): pairs that another search found; they are verified
    with the first round's and spare the second one what they join."""
    common = _common(docs, size)
    d = staged(_sets(docs, size, common), "similar-prefix")
    rows = staged(d.select("doc_id", "node"), "similar-rows")
    bits = staged(d.select("node", "n", "bits").dropDuplicates(["node"]), "similar-bits")
    p = d.select("node", "n", "set").dropDuplicates(["node"]).select("node", "n", F.posexplode("set").alias("at", "h"))
    p = staged(_with_hubs(p, common), "similar-met")
    unstage(d)
    tried = p.where(F.col("x.node") != F.col("hub.node")).where(_meet("x", "hub")).select(F.col("x.node").alias("u"), F.col("hub.node").alias("v"))
    tried = staged((tried if candidates is None else tried.unionByName(candidates)).distinct(), "similar-hubs")
    found = _similar(docs, tried, size, bits)
    root = staged(components(found), "similar-roots")
    placed = p.select("h", "x", F.col("x.node").alias("node")).join(root.hint("merge"), "node", "left").select("h", "x", F.coalesce("root", "node").alias("root"))
    placed = staged(placed, "similar-placed")
    unstage(p)
    # Members of a family do not meet each other; shingles that one family alone holds are done.
    still = placed.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h")
    p = staged(placed.join(still.hint("merge"), "h", "left_semi"), "similar-open")
    unstage(placed)
    a, b = (p.select("h", F.col("root").alias(f"r{k}"), F.col("x").alias(k)) for k in "ab")
    met = a.join(b.hint("merge"), "h").where("ra < rb").where(_meet("a", "b"))
    met = met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
    rest = staged(met.join(tried.hint("merge"), ["u", "v"], "left_anti"), "similar-rest")
    unstage(p)
    return rows, found.unionByName(_similar(docs, rest, size, bits))


def groups(docs: DataFrame, size: int = SIZE, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id, node, root of every row; rows with one root are one group."""
    rows, found = links(docs, size, candidates)
    root = components(found)
    return rows.join(root, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of every group of `grouped` (doc_id, node, root): the least id's, null last."""
    rows = grouped.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node", "n")).alias("x"))
    key, of, nth, best_key, best_of = fresh(docs, "_key", "_node", "_nth", "_best_key", "_best_node")
    best = staged(best.select(F.col("x.doc_id").alias(best_key), F.col("x.node").alias(best_of), F.col("x.n").alias("n")), "keep-one")
    d = docs.withColumns({of: node(value(docs, "text", "string")), key: value(docs, "doc_id", "long")})
    kept = d.join(best.select(best_key, best_of).hint("merge"), (F.col(of) == F.col(best_of)) & F.col(key).eqNullSafe(F.col(best_key)), "left_semi")
    if not best.where("n > 1").isEmpty():  # repeated rows; only then must texts move once more
        order = F.xxhash64(*own(docs))
        kept = kept.withColumn(nth, F.row_number().over(W.partitionBy(of, key).orderBy(order))).where(F.col(nth) == 1)
    return kept.select(*own(docs))
