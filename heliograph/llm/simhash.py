"""SimHash near-dedup with a generalised pigeonhole search.

A document's fingerprint has a bit where over half of its shingles' hashes have
it. Fingerprints that differ in `distance` bits at most are linked, and the
groups are the connected components of the links.

The search: the 64 bits are cut into m partitions with thresholds t_i of which
sum(t_i + 1) = distance + 1, so any two linked fingerprints lie within t_i on
at least one partition (a partition with t_i = -1 is not looked at). Bits that
are correlated share a partition, which leaves the other ones selective. m and
the thresholds come from a dynamic programme over estimated counts of
candidates and probes; the estimates use the frequencies and joint frequencies
of all bits over all distinct fingerprints (a 64 x 64 matrix, whatever the
input). Each fingerprint is indexed by its bits on a partition and probes with
all keys within t_i; pairs that meet are verified.

Equal fingerprints are one node, so thousands of copies of a text cost one row.
Buckets that hold more than `hot` different fingerprints are not paired: there
every fingerprint visits the points within 1 and within 2 bits of it (flipping
only bits that vary in the bucket) and is linked to the least fingerprint within
1 bit of the same point. Two at 3 bits or fewer always share such a point, so
the components are the same, at a cost that is linear in the bucket.

Defined results: a text without words (null too) has fingerprint zero and is
linked like any other; repeated rows share a group; a null id is no group's
name unless all are null; only doc_id and text are read for the decisions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import components
from ..runtime import staged, table
from .resemblance import SIZE, groups as similar_groups, keep_one, node
from .text import columns

SEED = 42
BITS = 64
DISTANCE = 3
HOT = 2000
_BLOCK = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of a text by word shingles of a size, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    total, ones = 0, np.zeros(BITS, np.int64)
    n = max(1, len(words) - size + 1)
    for k in range(0, n, _BLOCK):  # long texts in blocks, so that memory is bounded
        part = words[k : min(k + _BLOCK, n) + size - 1]
        if len(part) >= size:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        else:
            shingles = iter([b" ".join(part)])
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, named: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the node that names the text if `named`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", size) for t in col), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "node"][: batch.num_columns])

    d = columns(docs, doc_id="long", text="string")
    return (d.withColumn("node", node(F.col("text"))) if named else d).mapInArrow(run, "doc_id long, fp long" + ", node long" * named)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits, in how many both are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            c += x.T @ x
        rows = np.arange(BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([n] * BITS, pa.int64()), pa.array(c.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["i", "n", "c"])

    got = fps.select("fp").mapInArrow(run, "i int, n long, c array<long>").groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("c")[j]) for j in range(BITS)]).alias("c")).collect()
    c = np.zeros((BITS, BITS))
    for r in got:
        c[r["i"]] = r["c"]
    return (got[0]["n"] if got else 0), c


def partitions(n: int, c: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of about the same size, correlated ones together."""
    p = np.diag(c) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((c / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        rest = sorted(left)
        own = [max(rest, key=lambda b: r[b, rest].max())]
        while len(own) < width:
            own.append(max((b for b in rest if b not in own), key=lambda b: r[b, own].sum()))
        left -= set(own)
        out.append(sorted(own))
    return out


def differing(n: int, c: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The chance that two fingerprints differ in 0, 1, .. most of the bits.

    Bits are taken two by two, the most correlated first, with their joint frequencies.
    """
    p = np.diag(c) / max(1, n)
    left, poly = list(bits), np.array([1.0])
    while left:
        a = left.pop(0)
        if left:
            b = max(left, key=lambda b: abs(c[a, b] / max(1, n) - p[a] * p[b]))
            left.remove(b)
            both = c[a, b] / max(1, n)
            q = np.clip([1 - p[a] - p[b] + both, p[b] - both, p[a] - both, both], 0, 1)
            same, two = (q**2).sum(), 2 * (q[0] * q[3] + q[1] * q[2])
            block = np.array([same, max(0.0, 1 - same - two), two])
        else:
            block = np.array([p[a] ** 2 + (1 - p[a]) ** 2, 2 * p[a] * (1 - p[a])])
        poly = np.convolve(poly, block)[: most + 1]
    return np.pad(poly, (0, most + 1 - len(poly)))


def plan(n: int, c: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, min(distance + 2, 8)):
        parts = partitions(n, c, m)
        costs = []
        for bits in parts:
            d = np.cumsum(differing(n, c, bits, distance))
            probes = np.cumsum([float(np.prod([(len(bits) - j) / (j + 1) for j in range(t)])) for t in range(distance + 1)])
            costs.append([0.0, *(n * n / 2 * d + n * (1 + probes))])
        # table[s]: the least cost of the partitions so far with sum(t + 1) = s.
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (w, ts) in table_.items():
                for t, x in enumerate(cost):
                    if s + t <= distance + 1 and (s + t not in new or w + x < new[s + t][0]):
                        new[s + t] = (w + x, [*ts, t - 1])
            table_ = new
        w, ts = table_[distance + 1]
        if w < best[0]:
            best = w, [(b, t) for b, t in zip(parts, ts) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _near(bits: list[int], t: int) -> list[int]:
    return [_mask(x) for k in range(t + 1) for x in itertools.combinations(bits, k)]


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """fps (fp, distinct) to (u, v): links that connect all within the distance."""
    n, c = bit_statistics(fps)
    parts = plan(n, c, distance)
    key = lambda p: F.col("fp").bitwiseAND(_mask(p[0]))
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), key(p).alias("key")) for i, p in enumerate(parts)])).alias("x")).select("fp", "x.part", "x.key")
    flips = F.array(*[F.struct(F.lit(i).alias("part"), key(p).alias("key"), F.array(*[F.lit(x) for x in _near(p[0], p[1])]).alias("flips")) for i, p in enumerate(parts)])
    probe = fps.select("fp", F.explode(flips).alias("x")).select("fp", "x.part", F.col("x.key").alias("own"), F.explode("x.flips").alias("flip"))
    probe = probe.select("fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    full = staged(index.groupBy("part", "key").agg(F.count("*").alias("n"), F.expr("bit_or(fp) & ~bit_and(fp)").alias("wide")).where(F.col("n") > hot), "simhash-hot")
    some = full.count()
    a, b = index.alias("a"), probe.alias("b")
    if some:
        index, probe = (x.join(full.select("part", "key"), ["part", "key"], "left_anti") for x in (index, probe))
        a, b = index.alias("a"), probe.alias("b")
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    found = met.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if some:
        found = found.unionByName(_hot_links(fps, parts, full, distance))
    return found


def _hot_links(fps: DataFrame, parts: list[tuple[list[int], int]], full: DataFrame, distance: int) -> DataFrame:
    """Links among the fingerprints that probe a full bucket, without pairing them."""
    flips = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_mask(p[0])).alias("key"), F.array(*[F.lit(x) for x in _near(p[0], p[1])]).alias("flips")) for i, p in enumerate(parts)])
    q = fps.select("fp", F.explode(flips).alias("x")).select("fp", "x.part", F.col("x.key").alias("own"), F.explode("x.flips").alias("flip"))
    q = q.select("fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    q = q.join(full.select("part", "key"), ["part", "key"])
    q = staged(q, "simhash-hot-members")
    wide = q.groupBy("part", "key").agg(F.expr("bit_or(fp) & ~bit_and(fp)").alias("wide"))
    q = q.join(wide, ["part", "key"])
    one, two = (distance - 1) // 2, distance - (distance - 1) // 2
    varying = F.filter(F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)]), lambda x: x.bitwiseAND(F.col("wide")) != 0)
    q = q.withColumn("bits", varying).withColumn("ball", F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("d"), F.lit(-1).alias("last"))))
    for d in range(1, two + 1):
        grown = F.flatten(F.transform(F.filter("ball", lambda s: s["d"] == d - 1), lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size("bits") - 1), lambda i: (i > s["last"]) & (i >= 0) & (i < F.size("bits"))), lambda i: F.struct(s["x"].bitwiseOR(F.col("bits")[i]).alias("x"), F.lit(d).alias("d"), i.cast("int").alias("last")))))
        q = q.withColumn("ball", F.concat("ball", grown))
    q = q.select("part", "key", "fp", F.explode("ball").alias("s")).select("part", "key", "fp", F.col("fp").bitwiseXOR(F.col("s.x")).alias("point"), "s.d")
    hub = q.where(F.col("d") <= one).groupBy("part", "key", "point").agg(F.min("fp").alias("v"))
    return q.join(hub, ["part", "key", "point"]).where("fp <> v").select(F.col("fp").alias("u"), "v")


def groups(docs: DataFrame, size: int = 3, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    d = staged(fingerprints(docs, size), "simhash-fingerprints")
    fps = staged(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = components(links(fps.select("fp"), distance, hot))
    rooted = staged(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return d.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def candidates(docs: DataFrame, size: int = SIZE, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """u, v: pairs of texts (nodes) worth comparing. Texts with equal fingerprints meet the least of
    them, and the least ones of fingerprints that the search links meet; this is linear in the texts."""
    d = staged(fingerprints(docs, size, named=True).select("fp", "node").distinct(), "simhash-nodes")
    first = staged(d.groupBy("fp").agg(F.min("node").alias("first")), "simhash-first")
    same = d.join(first.hint("merge"), "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    l = links(first.select("fp"), distance, hot)
    far = l.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")).hint("merge"), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")).hint("merge"), "v")
    pairs = same.unionByName(far.select(F.col("a").alias("u"), F.col("b").alias("v"))).where("u <> v")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_dedup(docs: DataFrame, size: int = SIZE, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """The rows of docs that stay: one of every group of texts whose sets of `size`-word shingles
    have a similarity of 0.8 or more, by any chain of links.

    Fingerprints of these shingles find candidates; each pair is verified on the
    whole sets. Fingerprints alone would miss similar texts that differ in more
    bits, so the prefix filter of `resemblance`, which misses none, looks for what
    is not linked yet. The least id of a group stays, null last; texts that share
    an id are decided each.
    """
    found = staged(candidates(docs, size, distance, hot), "simhash-candidates")
    return keep_one(docs, staged(similar_groups(docs, size, found), "simhash-groups"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
