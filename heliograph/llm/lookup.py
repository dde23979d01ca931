"""A read-only hash table on numpy arrays: many keys are looked up at once."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(32), np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads them evenly."""
    x = keys.astype(np.uint64)
    x ^= x >> _A
    x *= _B
    x ^= x >> _C
    return x


class Lookup:
    """Distinct 64-bit keys, sorted after mixing, with an index on their leading bits."""

    def __init__(self, keys: np.ndarray, spread: bool = True):
        """spread=False: the keys are evenly spread hashes, and sorted; then they are used as they are."""
        self.spread = spread
        if spread:
            self.keys = mixed(keys)
            self.order = np.argsort(self.keys)
            self.keys = self.keys[self.order]
        else:
            self.keys = keys
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        for k in range(0, len(self.keys), 1 << 20):  # by parts, so that little memory is needed besides
            at, n = np.unique(self.keys[k : k + (1 << 20)] >> self.shift, return_counts=True)
            self.starts[at.astype(np.int64) + 1] += n.astype(np.int32)
        np.cumsum(self.starts, out=self.starts)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the order of self.keys, -1 where it is missing."""
        q = mixed(keys) if self.spread else keys
        at = (q >> self.shift).astype(np.int64)
        place, end = self.starts[at], self.starts[at + 1]
        out = np.full(len(q), -1, np.int64)
        live = np.flatnonzero(place < end)
        while live.size:
            p = place[live]
            hit = self.keys[p] == q[live]
            out[live[hit]] = p[hit]
            live = live[~hit]
            place[live] += 1
            live = live[place[live] < end[live]]
        return out
