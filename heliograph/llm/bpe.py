"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut by the tokenizer's pattern. Pieces that a worker hasn't met lately
are sorted into buckets by length, each bucket a padded matrix of byte tokens.
In every round all rows merge their leftmost pair of least rank together: ranks
come from a hashed table of pairs, merged rows close up by one gather, rows
without a pair leave. A piece that is a token itself is that token. Pieces of
over LONGEST bytes, for which rounds would cost the square of their length,
take the same merges from a heap.

Defined results: a null or empty text has no tokens; any text decodes to its own
UTF-8 bytes; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .lookup import Lookup
from .text import columns

NONE = np.int32(2**31 - 1)
LONGEST = 256
#: A worker's memory of pieces; it starts anew when full, so it is bounded.
REMEMBERED = 150_000
#: Characters of text that are cut before their new pieces are encoded.
AT_ONCE = 1_000_000


class BytePairs:
    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.pairs = Lookup((left << 32 | right).astype(np.uint64))
        self.merged = merged.astype(np.int32)[self.pairs.order]
        self.memory: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank (which is the id) of each merged pair, NONE where there is none."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(left.size, NONE, np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        at = self.pairs.find((left[real] << 32 | right[real]).astype(np.uint64))
        out[real[at >= 0]] = self.merged[at[at >= 0]]
        return out.reshape(shape)

    def bucket(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of like length, as little-endian 32-bit integers."""
        width = max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        m = np.full((len(pieces), width), -1, np.int32)
        m[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        rank = self.rank(m[:, :-1], m[:, 1:])
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for r, ids in zip(rows[done], m[done]):
                    out[r] = ids[ids >= 0].astype("<u4").tobytes()
                rows, m, rank, at, least = rows[~done], m[~done], rank[~done], at[~done], least[~done]
            if not len(rows):
                return out
            here = np.arange(len(rows))
            m[here, at] = least
            keep = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, keep + (keep > at[:, None]), 1)
            keep = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            # Only the pairs on either side of the merged token are new.
            for k in (at - 1, at):
                ok = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                rank[ok, k[ok]] = self.rank(m[ok, k[ok]], m[ok, k[ok] + 1])

    def long_piece(self, piece: bytes) -> bytes:
        """The same merges in n log n steps: a linked list, and a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        get = {}

        def rank(a: int, b: int) -> int | None:
            if (a, b) not in get:
                get[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b])
            return get[a, b]

        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (q := rank(ids[x], ids[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[after[x]]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces into the memory."""
        by: dict[int, list[str]] = {}
        raw = {p: p.encode() for p in pieces}
        for p, b in raw.items():
            if b in self.ranks:
                self.memory[p] = self.ranks[b].to_bytes(4, "little")
            elif len(b) > LONGEST:
                self.memory[p] = self.long_piece(b)
            else:
                by.setdefault((len(b) - 1).bit_length(), []).append(p)
        for own in by.values():
            for k in range(0, len(own), 50_000):
                part = own[k : k + 50_000]
                self.memory.update(zip(part, self.bucket([raw[p] for p in part])))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        k = 0
        while k < len(texts):
            own, chars = [], 0
            while k < len(texts) and chars < AT_ONCE:
                own.append(texts[k])
                chars += len(texts[k])
                k += 1
            cut = [self.find(t) for t in own]
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self.learn({p for c in cut for p in set(c)} - self.memory.keys())
            get = self.memory.__getitem__
            for c in cut:
                yield b"".join(map(get, c))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, BytePairs] = {}


def _pairs(ranks: bytes, pattern: str) -> BytePairs:
    """One for each worker, which its later tasks use again."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = BytePairs(ranks, pattern)
    return _made[key]


def tokenizer(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The contents of a file of ranks, and the pattern; by default the 50k byte-level vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int, on demand), n_tokens and the digests of the ids and of what they decode to.

    The vocabulary is one file of fixed size; it goes to the workers by broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(*sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b, all_ids = [], [], [], []
            for got in pairs.encode(texts):
                n.append(len(got) // 4)
                a.append(hashlib.sha256(got).hexdigest())
                b.append(hashlib.sha256(pairs.decode(got)).hexdigest())
                if ids:
                    all_ids.append(got)
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if ids:
                flat = pa.array(np.frombuffer(b"".join(all_ids), "<i4"), pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_pydict(cols)

    d = columns(docs, doc_id="long", text="string")
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
