"""Best-fit packing of token sequences by exact complements.

Only the number of pieces of each length matters, so the plan is made on the histogram of lengths,
which has no more entries than a sequence has tokens, however many documents there are. For each
length, longest first, an index of the sums of one, two and three other lengths is asked for what
fills its gap exactly, as often as the counts allow; what finds no complement is packed best-fit.
The plan is a list of patterns with counts; pieces find their place by their rank among their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import leave_out, numbered, pick, plainly, slices, stored, told_apart
from .wordcodes import ChunkCodes

# Texts of these code points only: NFC, lower-case letter by letter, and white space separates words.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u02ff\\u2010-\\u2027]")

# The word pattern of the vocabulary, for lower-case text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

# Histogram


class SumIndex:
    """Which gaps one, two or three of the available lengths fill, as bit sets over the sums."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.limit = len(counts) - 1
        self.rebuild()

    def rebuild(self):
        lengths = np.flatnonzero(self.counts)
        self.lengths = lengths[::-1]
        mask = (1 << (self.limit + 1)) - 1
        single = sum(1 << int(n) for n in lengths)
        pair = 0
        for n in lengths.tolist():
            pair |= single << n
        self.single, self.pair = single, pair & mask
        self.there = np.unpackbits(np.frombuffer(single.to_bytes(self.limit // 8 + 1, "little"), np.uint8), bitorder="little")[: self.limit + 1] > 0
        self.pair_there = np.unpackbits(np.frombuffer(self.pair.to_bytes(self.limit // 8 + 1, "little"), np.uint8), bitorder="little")[: self.limit + 1] > 0

    def enough(self, combination: tuple[int, ...]) -> bool:
        return all(self.counts[n] >= k for n, k in Counter(combination).items())

    def complement(self, length: int, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """At most ``most`` lengths that fill the gap beside ``length``, fewest first, then longest first."""
        if most < 1:
            return None
        if gap > 0 and self.single >> gap & 1 and self.enough((length, gap)):
            return (gap,)
        if most > 1 and self.pair >> gap & 1 and (found := self.two(gap, (length,))):
            return found
        first = self.lengths[self.lengths < gap] if most > 2 else self.lengths[:0]
        for n in first[self.pair_there[gap - first]].tolist():
            if found := self.two(gap - n, (length, n)):
                return (n, *found)
        return None

    def two(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for n in a[self.there[a] & self.there[gap - a]].tolist():
            if self.enough((*beside, n, gap - n)):
                return n, gap - n
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, lengths in each) that hold every piece exactly once.

    Complements of up to three lengths are consumed; where fewer waste less, the plan with fewer is taken.
    """
    least = -(-sum(n * k for n, k in histogram.items()) // capacity)
    best = None
    for most in (3, 2, 1, 0):
        found = complemented(histogram, capacity, most)
        used = sum(times for times, _ in found)
        if best is None or used < best[0]:
            best = used, found
        if used == least:
            break
    return best[1]


def complemented(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[int, list[int]]]:
    """Exact complements of at most ``most`` lengths, then best fit for the rest."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[tuple[int, list[int]]] = []
    if counts[capacity]:
        out.append((int(counts[capacity]), [capacity]))
        counts[capacity] = 0
    index = SumIndex(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length] and (found := index.complement(length, capacity - length, most)):
            pattern = [length, *found]
            need = Counter(pattern)
            times = min(int(counts[n]) // k for n, k in need.items())
            out.append((times, pattern))
            for n, k in need.items():
                counts[n] -= times * k
            if any(counts[n] == 0 for n in need):
                index.rebuild()
    return out + best_fit(counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts: equal open sequences are handled together."""
    open_: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]  # by gap
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            gap = next((g for g in range(length, capacity) if open_[g]), None)
            if gap is None:
                gap, group = capacity, (left, [])
            else:
                group = open_[gap].pop()
            fit = gap // length
            full = min(group[0], left // fit)
            if full:
                open_[gap - fit * length].append((full, group[1] + [length] * fit))
                left -= full * fit
                group = (group[0] - full, group[1])
            if left and group[0] and left < fit:
                open_[gap - left * length].append((1, group[1] + [length] * left))
                group, left = (group[0] - 1, group[1]), 0
            if gap < capacity and group[0]:
                open_[gap].append(group)
    return [group for groups in open_ for group in groups]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go by rank: runs of ranks with their first sequence and offset."""
    used: Counter = Counter()
    rows, base = [], 0
    for times, pattern in patterns:
        at = 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length << 44 | used[length], base, k, at, length, used[length]))
            used[length] += times * k
            at += length * k
        base += times
    rows.sort()
    return {c: np.array(v, np.int64) for c, v in zip(("key", "base", "each", "offset", "length", "rank"), zip(*rows))} if rows else {}


# Tokens


class Pieces:
    """Ids of whole texts as the tokenizers library gives them.

    Texts of plain code points are coded by distinct chunks; all others go through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Merges(path)
        self.codes = ChunkCodes(self.code_many)

    def code_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(WORDS.findall, chunks))
        flat, sizes = self.merges.merged_together([w.encode() for words in split for w in words])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.r_[0, np.cumsum(sizes)]
        last = np.cumsum(counts)
        return flat, ends[last] - ends[last - counts]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        chunked, whole = [], {}
        for i, text in enumerate(texts):
            if text and (PLAIN.search(text) or ("<" in text and any(s in text for s in self.specials))):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                text = None
            chunked.append(text.lower().split() if text else [])
        coded = self.codes.encode(chunked)
        return [whole.get(i, ids) for i, ids in enumerate(coded)]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def token_pieces(df: DataFrame, path: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document: its ids, then ``end_id``, cut only beyond ``capacity``.

    A null or empty text has the end id only. ``ids`` are little-endian unsigned 32-bit, as binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for part in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), pieces.encode(part.column("text").to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                rows += [(doc_id, i, at, len(ids[at : at + capacity]), ids[at : at + capacity].tobytes()) for i, at in enumerate(range(0, len(ids), capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids"])

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Every row with ``sequence_id`` and ``offset``: gapless places in sequences of at most ``capacity``.

    Lengths are 1 to ``capacity``; other lengths (and nulls) raise. Columns may hold nulls and rows may
    repeat: each gets its own place. Which of equal lengths goes where depends on a hash of the row, so
    retried tasks agree. An empty table stays empty. Columns ``sequence_id`` and ``offset`` are replaced.
    The histogram (at most ``capacity`` rows) and the plan made of it are all that passes the driver;
    the plan's size depends on ``capacity``, not on the rows.
    """
    pieces = leave_out(pieces, "sequence_id", "offset")
    names = pieces.columns
    pieces, _ = plainly(pieces, length=length_col)
    mixed, _ = told_apart(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if wrong := [n for n in histogram if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {wrong[:5]}")
    places = slots(plan(histogram, capacity))
    ranked = numbered(mixed, ["length"], ["_mix", "_copy"], "_place").drop("_mix", "_copy")
    kept = [c for c in ranked.columns if c != "_place"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_place"))
            at = np.searchsorted(places["key"], length << 44 | rank, side="right") - 1 if len(batch) else np.zeros(0, int)
            row = {c: v[at] for c, v in places.items()} if len(batch) else dict.fromkeys(("rank", "each", "base", "offset"), rank)
            each = np.maximum(row["each"], 1)
            past = rank - row["rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(row["base"] + past // each), pa.array(row["offset"] + past % each * length)],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").toDF(*names, "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places, ids as ``ids_crc32`` (``token_pieces`` has the ids)."""
    cut = token_pieces(df, path, capacity, end_id)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(slim, "pieces"), capacity)
