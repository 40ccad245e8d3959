"""Vectorised 64-bit hashing of words and word shingles (numpy, used inside
Arrow tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose output bits look random."""
    z = (z ^ (z >> _S30)) * _A
    z = (z ^ (z >> _S27)) * _B
    return z ^ (z >> _S31)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= STEP
        acc += h[j : j + m]
    return mix(acc)


def shingles(words: list[str], n: int = 5) -> np.ndarray:
    """Hashes of all ``n``-word shingles, with repeats. A text of 1 to n-1
    words has one shingle, all its words; a text without words has none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return gram_hashes(word_hashes(words), min(n, len(words)))


def occurrence_ids(values: np.ndarray) -> np.ndarray:
    """Sorted distinct ids of a multiset: the i-th repeat of a value gets an
    id of its own, so multiset overlap becomes plain set overlap."""
    v = np.sort(values)
    if not len(v):
        return v
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    nth = np.arange(len(v)) - np.repeat(start, np.diff(np.r_[start, len(v)]))
    return np.sort(mix(v + nth.astype(np.uint64) * STEP))
