"""Hashes of words and word runs, for workers. Words are the WORD runs of a text: what bytes.split() yields."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 200_000
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 0xD1B54A32D192ED03 * (i * i + 1)) % 2**64 | 1 for i in range(64)], np.uint64)


class WordHasher(dict):
    """Word (bytes) -> 64-bit hash, remembered up to MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by their starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _MULTIPLIERS[0]
    for i in range(1, k):
        total = total + words[i : i + n] * _MULTIPLIERS[i % 64]
    return mixed(total + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer than ``k`` words the whole sequence is the only one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(words, min(k, len(words))))
