"""Shingle hashes shared by the fingerprint and licence operators."""

from __future__ import annotations

import numpy as np
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter."""
    w = word_hashes(words)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _A + w[i:len(w) - n + 1 + i]
    return mix(h)
