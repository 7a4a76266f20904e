"""Hashed words and five-word shingles in numpy, the same on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

K = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered; emptied when it grows past ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, split at ASCII white space only."""
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """One hash per run of ``k`` words; a shorter text is a single shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _P + words[i : n - k + 1 + i]
    return mix(out)


def multiset(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(shingles, return_counts=True)


def as_set(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: the c-th copy of a value becomes an element of its own, so set overlap is multiset overlap."""
    if len(values) and counts.max() > 1:
        copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        values = np.repeat(values, counts)
        values = np.where(copy == 0, values, mix(values + copy.astype(np.uint64) * _P))
    return np.sort(values)
