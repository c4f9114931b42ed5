"""64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of the run hash.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


class WordHashes(dict):
    """Word -> hash; forgotten when there are too many, which costs time only."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(FACTORS[1])
    return x ^ (x >> np.uint64(29))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(FACTORS[0]) + hashes[i : i + n]
        out ^= out >> np.uint64(32)
    return mixed(out)
