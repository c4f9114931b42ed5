"""Codes of texts made of repeated chunks: every distinct chunk is coded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class _Places(dict):
    """Chunk -> place, in order of first sight."""

    def __missing__(self, chunk):
        place = len(self)
        self[chunk] = place
        return place


class ChunkCodes:
    """Concatenated code arrays of chunk sequences.

    ``code_many`` maps new chunks to all their codes and the number of each. Places are forgotten between batches
    once there are more than ``most`` of them, which costs time only.
    """

    def __init__(self, code_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.code_many, self.most = code_many, most
        self._clear()

    def _clear(self):
        self.places = _Places()
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int32)

    def _learn(self):
        known = len(self.sizes)
        if len(self.places) == known:
            return
        fresh = list(self.places)[known:] if known < 1000 else self._tail(known)
        flat, sizes = self.code_many(fresh)
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.codes = np.concatenate([self.codes, flat.astype(np.int32)])

    def _tail(self, known: int) -> list[str]:
        fresh = []
        for chunk in reversed(self.places):
            if len(fresh) == len(self.places) - known:
                break
            fresh.append(chunk)
        return fresh[::-1]

    def encode(self, texts: list[Sequence[str]]) -> list[np.ndarray]:
        if len(self.places) > self.most:
            self._clear()
        look = self.places.__getitem__
        placed = [np.fromiter(map(look, chunks), np.int64, len(chunks)) for chunks in texts]
        self._learn()
        return [self._gather(p) for p in placed]

    def _gather(self, places: np.ndarray) -> np.ndarray:
        sizes = self.sizes[places]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        # Position in the code store: start of the own chunk plus distance from the chunk's first code.
        at = np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(total)
        return self.codes[at]
