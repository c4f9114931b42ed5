"""Requests answered from the ordered frames of their media, many media at a time.

Frames and requests are brought together by media once. A task reads whole media, as many as fit one
batch, puts their frames in order and looks all times up in them; nothing is joined back to the requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import FRAME_ORDER
from .order import Ordered, chunk_rows, small_groups

ROW, ASKED = "_row", "_asked"
OUT_ROWS = 20_000
AT_ONCE = 1_000_000


@dataclass
class Frames:
    """The frames of some media, media by media and in order, and where those of each request begin and end."""

    rows: pa.StructArray
    times: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def whole(self, name: str, absent: int) -> np.ndarray:
        return _whole(self.rows.field(name), absent)

    def place(self, wanted: np.ndarray, past: bool = False, of: np.ndarray | None = None) -> np.ndarray:
        """The first frame of each request's media (``of``: requests) at or after a time, or ``past`` it."""
        low, high = (x.copy() if of is None else x[of] for x in (self.begin, self.end))
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            at = self.times[np.where(open_, middle, 0)]
            on = open_ & (at <= wanted if past else at < wanted)
            low, high = np.where(on, middle + 1, low), np.where(open_ & ~on, middle, high)
        return low


def _whole(array: pa.Array, absent: int) -> np.ndarray:
    return pc.fill_null(array.cast(pa.int64()), absent).to_numpy(zero_copy_only=False)


def even(requests: DataFrame, frames: DataFrame | Ordered, targets: str | None = None, few: bool | None = None) -> bool:
    """Whether no media has more frames or more requests (or ``targets`` of them) than a chunk, so that each fits one task.
    ``few`` tells so of the requests where the caller has counted them."""
    if frames.split if isinstance(frames, Ordered) else not small_groups(frames.select("media_id")):
        return False
    if few or targets is None:
        return few or small_groups(requests.select("media_id"))
    sizes = requests.groupBy("media_id").agg(F.sum(F.size(targets)).alias("_n"))
    return sizes.where(F.col("_n") > chunk_rows(requests)).isEmpty()


def looked_up(
    requests: DataFrame, frames: DataFrame | Ordered, payload: list[str], answer: Callable[[pa.Table, Frames], Iterable[pa.Table]], added: list[StructField], drop: tuple[str, ...] = ()
) -> DataFrame:
    """What ``answer`` makes of the requests of whole media and their frames: columns of the requests and ``added`` ones."""
    source = frames.plain() if isinstance(frames, Ordered) else frames
    ranks = [c for c in FRAME_ORDER if c in source.columns]
    row, asked = F.struct(*dict.fromkeys([*ranks, *payload])), F.struct(*requests.columns)
    timed = source.where(F.col("pt_ns").isNotNull() & F.col("media_id").isNotNull()).select("media_id", row.alias(ROW))
    both = timed.unionByName(requests.select("media_id", asked.alias(ASKED)), allowMissingColumns=True)
    fields = [f for f in requests.schema.fields if f.name not in drop]
    names = [f.name for f in [*fields, *added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for media in _whole_media(batches):
            for table in answer(*_ordered(media, ranks)):
                yield from table.select(names).to_batches(OUT_ROWS)

    # By a hash, not by the media itself: where both sides are dealt out by media already, a union counts as dealt out too,
    # yet its partitions are those of one side after those of the other.
    return both.repartition(F.xxhash64("media_id")).sortWithinPartitions("media_id").mapInArrow(run, StructType([*fields, *added]))


def _whole_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole media; the last media of a batch may go on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("media_id")
        if held and held[-1].column("media_id")[-1] != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        same = pc.equal(ids, ids[-1]) if ids[-1].is_valid else pc.is_null(ids)
        cut = pc.index(pc.fill_null(same, False), True).as_py()
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _ordered(media: pa.Table, ranks: list[str]) -> tuple[pa.Table, Frames]:
    media = media.combine_chunks()
    one = lambda c: media.column(c).chunk(0)
    code = pc.dictionary_encode(one("media_id"), null_encoding="encode").indices.to_numpy()
    is_row = one(ROW).is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(is_row)
    rows = one(ROW).take(pa.array(at))
    order = np.lexsort([*[_whole(rows.field(c), -(2**63)) for c in reversed(ranks)], code[at]])
    rows, placed = rows.take(pa.array(order)), code[at][order]
    asked = one(ASKED).take(pa.array(np.flatnonzero(~is_row)))
    wanted = code[~is_row]
    sides = [np.searchsorted(placed, wanted, side) for side in ("left", "right")]
    return pa.table(asked.flatten(), names=[f.name for f in asked.type]), Frames(rows, _whole(rows.field("pt_ns"), 0), *sides)


def nearest_frames(requests: DataFrame, frames: DataFrame | Ordered, payload: list[str], targets: str, repeats: bool = True) -> DataFrame:
    """One row per target time in the array ``targets`` of each request, in place of the array: ``ordinal`` (from 0), ``target_ns`` and ``hit``,
    the frame nearest to it or null. Media are ``even``.

    Without ``repeats`` a frame counts once per request_id, at its first target, targets without a frame are left
    out, and those left are numbered in order of time.
    """
    source = frames.plain() if isinstance(frames, Ordered) else frames
    hit = source.select(F.struct(*dict.fromkeys([*[c for c in FRAME_ORDER if c in source.columns], *payload])).alias("hit")).schema["hit"]

    def answer(asked: pa.Table, held: Frames) -> Iterator[pa.Table]:
        lists = asked.column(targets).chunk(0) if asked.num_rows else pa.array([], pa.list_(pa.int64()))
        owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        known, times = lists.flatten().is_valid().to_numpy(zero_copy_only=False), _whole(lists.flatten(), 0)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        position = np.where(known, _nearest(held, times, owner), -1)
        if not repeats:
            owner, times, position, place = _first_hits(asked, held, owner, times, position)
            known = np.ones(len(owner), bool)
        for a in range(0, len(owner), AT_ONCE):
            at = slice(a, a + AT_ONCE)
            out = asked.drop_columns([targets]).take(pa.array(owner[at]))
            added = [pa.array(place[at]), pa.array(times[at], mask=~known[at]), held.rows.take(pa.array(position[at], mask=position[at] < 0))]
            for name, array in zip(("ordinal", "target_ns", "hit"), added):
                out = out.append_column(name, array)
            yield out

    added = [StructField("ordinal", LongType()), StructField("target_ns", LongType()), StructField("hit", hit.dataType)]
    return looked_up(requests, frames, payload, answer, added, (targets,))


def _nearest(held: Frames, times: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Exact hit first, else the closer frame; the earlier one on a tie; either end alone; -1 for none."""
    if not len(held.times):
        return np.full(len(times), -1)
    after = held.place(times, of=owner)
    before = after - 1
    has_after, has_before = after < held.end[owner], before >= held.begin[owner]
    later, earlier = held.times[np.where(has_after, after, 0)], held.times[np.where(has_before, before, 0)]
    # Unsigned, as a gap may exceed BIGINT.
    gap = lambda a, b: a.view(np.uint64) - b.view(np.uint64)
    closer = has_before & ~(has_after & (later == times)) & (~has_after | (gap(times, earlier) <= gap(later, times)))
    return np.where(closer, before, np.where(has_after, after, -1))


def _first_hits(asked: pa.Table, held: Frames, owner: np.ndarray, times: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, time, position and number of the first hit of every frame of a request."""
    some = position >= 0
    owner, times, position = owner[some], times[some], position[some]
    # Frames with an index are the same by index, others by time and pts.
    index = held.whole("presentation_index", -1)
    unnamed = index < 0
    pts = held.rows.field("pts")
    keys = [np.where(unnamed, -1, index), *[np.where(unnamed, x, 0) for x in (held.times, _whole(pts, 0), pts.is_valid().to_numpy(zero_copy_only=False))]]
    frame = _numbered(keys)[position]
    # Rows of one request_id of a media are one request, which the first of them stands for.
    ids = pc.dictionary_encode(asked.column("request_id").chunk(0), null_encoding="encode").indices.to_numpy() if asked.num_rows else np.zeros(0, int)
    media = pc.dictionary_encode(asked.column("media_id").chunk(0), null_encoding="encode").indices.to_numpy() if asked.num_rows else np.zeros(0, int)
    same = _numbered([media, ids])
    _, first = np.unique(same, return_index=True)
    owner = first[same[owner]]
    order = np.lexsort((times, frame, owner))
    owner, times, position, frame = (x[order] for x in (owner, times, position, frame))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (frame[1:] != frame[:-1])
    owner, times, position = owner[new], times[new], position[new]
    order = np.lexsort((times, owner))
    owner = owner[order]
    return owner, times[order], position[order], np.arange(len(owner)) - np.searchsorted(owner, owner)


def _numbered(keys: list[np.ndarray]) -> np.ndarray:
    """Equal numbers for equal rows of the keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out
