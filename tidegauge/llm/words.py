"""Word hashes of texts, for the operators that compare documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


EDGES = re.compile(r"^\W+|\W+$")


def bare(word: str) -> str:
    """A word in lower case without the punctuation around it, or as it is if there is nothing else."""
    return EDGES.sub("", word).lower() or word


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(29))


class WordHasher:
    """64-bit hashes of words, remembered up to `limit` of them. fold: what a word is before it is hashed."""

    def __init__(self, limit: int = 200_000, fold: Callable[[str], str] | None = None):
        self.seen: dict = {}
        self.limit = limit
        self.fold = fold or (lambda w: w)

    def __call__(self, words: list) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(self.fold(w))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * MIX + hashes[j : n - k + 1 + j]
    return mix(out)
