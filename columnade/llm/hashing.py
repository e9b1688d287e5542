"""Hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words)) if seed else np.fromiter(map(digest, words), np.uint64, len(words))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * _BASE + h[j : j + n]
        out ^= out >> np.uint64(31)
        out *= _MIX
        return out ^ (out >> np.uint64(29))
