"""Word shingles of whole texts as sorted sets of 64-bit hashes, and exact overlaps of two sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Distinct words whose hashes a worker keeps.
MEMO = 300_000
#: Odd multiplier of the polynomial over word hashes (64-bit golden ratio).
ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Lower-cases A-Z, cuts at ASCII white space, hashes every run of ``WORDS`` words."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        memo, words = self.memo, text.lower().split()
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes; empty without words; one hash of the whole sequence with fewer than ``WORDS``."""
        w = self.words(text) if text else np.empty(0, np.uint64)
        if not len(w):
            return w
        n = min(len(w), WORDS)
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * ODD + w[i : len(w) - n + 1 + i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set: equal for equal sets."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard of at least percent / 100, in integers."""
    both = overlap(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def spanning(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each node over the links i - j."""
    root = np.arange(nodes)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (low == root[i]).all() and (low == root[j]).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    return root
