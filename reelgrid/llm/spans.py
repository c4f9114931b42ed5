"""Spans of a text: (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind in the given order, comma-joined."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], place[s[0]], s[2])))


def free_of(spans: Sequence[Span], taken: Sequence[Span]) -> list[Span]:
    """Spans that overlap none of the taken ones."""
    held = sorted((a, b) for _, a, b in taken)
    starts, furthest = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    # Of the taken spans that start before this one ends, does the furthest end lie behind its start?
    free = lambda a, b: not (at := bisect_left(starts, b)) or furthest[at - 1] <= a
    return [s for s in sorted(spans, key=lambda s: (s[1], s[2])) if free(s[1], s[2])]


def tabled(df: DataFrame, find: Callable[[], Callable[[list[str]], list[tuple[list[Span], list[Span]]]]], base: Sequence[str], kinds: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: counts and digest of the base spans, all spans as a string and as structs.

    ``find()`` makes the finder once per task; it takes whole texts and gives (base, added) spans.
    """
    counted = [f"n_{k}" for k in base]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = find()
        for part in slices(batches, "text"):
            found = finder([t or "" for t in part.column("text").to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in base]
            digests = [hashlib.sha256(joined(own, kinds).encode()).hexdigest() for own, _ in found]
            every = [joined([*own, *more], kinds) for own, more in found]
            structs = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted([*own, *more], key=lambda s: s[1])] for own, more in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *counts, pa.array(digests), pa.array(every), pa.array(structs, pa.list_(span))], ["doc_id", *counted, "base_sha256", "spans", "span_list"]
            )

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    schema = ", ".join(f"{c} long" for c in counted)
    return rows.mapInArrow(run, f"doc_id long, {schema}, base_sha256 string, spans string, span_list array<struct<kind:string,start:bigint,end:bigint>>")
