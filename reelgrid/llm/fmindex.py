"""A compressed full-text index over integer symbols: BWT in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. ``ranks``: first symbols, dense from 0; ends must be unique."""
    n, step = len(ranks), 1
    ranks = ranks.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = ranks[step:] + 1
        keys = ranks * (n + 2) + second
        order = np.argsort(keys, kind="stable")
        new = np.empty(n, np.int64)
        sorted_ = keys[order]
        new[order] = np.r_[0, np.cumsum(sorted_[1:] != sorted_[:-1])]
        if new.max() == n - 1:
            return order
        ranks, step = new, step * 2


class Bits:
    """Packed bits with a count before every 64."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[: len(packed)] = packed
        self.words = words.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.r_[np.uint32(0), np.cumsum(counts, dtype=np.uint32)[:-1]]
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Index of a text of symbols ending in unique separators (symbol 0 in the BWT).

    ``text``: symbols from 1 for words, 0 for separators. The suffix array is kept as long as the
    caller needs positions; searching needs the wavelet matrix and the symbol counts only.
    """

    def __init__(self, text: np.ndarray):
        breaks = text == 0
        first = text + int(breaks.sum())
        first[breaks] = np.arange(int(breaks.sum()))
        first = np.unique(first, return_inverse=True)[1]
        self.order = suffix_array(first)
        symbols = text[self.order - 1]
        self.depth = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        self.starts = np.r_[0, np.cumsum(counts)]
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            bits = Bits(bit)
            self.levels.append((bits, len(bit) - bits.ones))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns extended to the left by one symbol each."""
        a, b, base = low, high, np.zeros(len(low), np.int64)
        for place, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - place) & 1).astype(bool)
            ra, rb, rz = bits.rank(a), bits.rank(b), bits.rank(base)
            a = np.where(one, zeros + ra, a - ra)
            b = np.where(one, zeros + rb, b - rb)
            base = np.where(one, zeros + rz, base - rz)
        return self.starts[symbol] + a - base, self.starts[symbol] + b - base


def repeated_windows(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each window (start, ``size`` symbols): its earliest start in the text.

    Matching statistics by backward search: a window is extended to the left from its last symbol for
    as long as what it has matched stands elsewhere too; only those that reach ``size`` are repeats.
    """
    index = FmIndex(text)
    earliest = starts.copy()
    open_ = np.arange(len(starts))
    last = text[starts + size - 1]
    low, high = index.starts[last], index.starts[last + 1]
    for back in range(size - 2, -1, -1):
        more = high - low > 1
        open_, low, high = open_[more], low[more], high[more]
        if not len(open_):
            return earliest
        low, high = index.step(low, high, text[starts[open_] + back])
    more = high - low > 1
    open_, low, high = open_[more], low[more], high[more]
    if len(open_):
        places, which = np.unique(low, return_inverse=True)
        ends = np.zeros(len(places), np.int64)
        ends[which] = high
        # Intervals of equally long patterns are disjoint: minima by pairs of bounds.
        bounds = np.stack([places, ends], axis=1).ravel()
        least = np.minimum.reduceat(np.r_[index.order, np.iinfo(np.int64).max], bounds)[::2]
        earliest[open_] = least[which]
    return earliest
