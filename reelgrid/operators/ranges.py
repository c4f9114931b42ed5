"""Closed time ranges: listing the rows inside and summarising them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sweep
from .order import Ordered, arrange, sequence, settle

BLOCK_ROWS = 256


def _closed(ranges: DataFrame) -> DataFrame:
    return ranges.withColumns(
        {"start_ns": F.least("start_ns", "end_ns"), "end_ns": F.greatest("start_ns", "end_ns")}
    )


def rows_in_ranges(
    rows: DataFrame | Ordered,
    ranges: DataFrame,
    time: str = "pt_ns",
    start: str = "start_ns",
    end: str = "end_ns",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Every (range, row) pair with the row inside the closed range.

    A sweep turns both ends into positions, so a range is an interval of row positions whatever its
    duration. Rows are joined once each, by blocks of ``block`` consecutive positions; a range is listed per
    block it meets, and only its first and last block can hold rows outside.
    """
    source = rows.plain() if isinstance(rows, Ordered) else rows
    timed = source.withColumn("_time", F.col(time)).where(F.col("_time").isNotNull())
    ends = {"_start": F.least(start, end), "_end": F.greatest(start, end)}
    r = ranges.withColumns(ends).where(F.col("_start").isNotNull())
    times = timed.select("media_id", F.col("_time").alias("pt_ns"))
    if isinstance(rows, Ordered) and not rows.split:
        # Known to be small; counted once, by whoever ordered them.
        times, timed = Ordered(times, order=("pt_ns",)), Ordered(timed, order=("_time",))
    listed = sweep.positions(r, times, "_start", "_end").where("p0 <= p1").drop("_start", "_end")
    of = lambda c: F.call_function("div", c, F.lit(block))
    listed = listed.withColumn("_block", F.explode(F.sequence(of(F.col("p0")), of(F.col("p1")))))
    placed = sequence(arrange(timed, order=("_time",)), names=("_place", "", "")).plain().drop("_time")
    pairs = placed.withColumn("_block", of(F.col("_place"))).join(listed, ["media_id", "_block"])
    return pairs.where(F.col("_place").between(F.col("p0"), F.col("p1"))).drop("_block", "_place", "p0", "p1")


def range_summary(ranges: DataFrame, frames: DataFrame | Ordered) -> DataFrame:
    """First and last frame, known count and exact count of each range.

    Counts come from the sweep's totals at the two ends, not from listing rows. The exact count is known
    only when indices are contiguous and both ends fall on frame times.
    """
    r = _closed(ranges)
    if sweep.even(r, frames):
        found = sweep.searched(r, frames, ["presentation_index"], _runs_of_indices).withColumn("_n", F.col("p1") - F.col("p0") + 1)
        side = lambda s: {c: F.col(f"{s}_{c}") for c in ("presentation_index", "pt_ns", "gaps")}
        return _summary(found, ranges.columns, F.col("_n"), side("first"), side("last"))
    o = sweep.events(r.select("media_id", "start_ns", "end_ns").distinct(), frames, ["presentation_index", "pt_ns"])
    o = sweep.before(o, F.col("_row.presentation_index"), "_last_index")
    follows = F.coalesce(F.col("_row.presentation_index") == F.col("_last_index") + 1, F.lit(False))
    o = sweep.counted(sweep.counted(o, F.lit(1), "_n"), F.when(follows, 0).otherwise(1), "_gaps")
    here = F.struct(F.col("_row.presentation_index").alias("presentation_index"), F.col("_row.pt_ns").alias("pt_ns"), F.col("_gaps").alias("gaps"))
    o = sweep.after(sweep.before(o, here, "_before"), here, "_after")
    j = r.join(sweep.paired(o, ["_n", "_after"], ["_n", "_before"]), ["media_id", "start_ns", "end_ns"], "left")
    count = F.coalesce(F.col("e._n") - F.col("s._n"), F.lit(0).cast("bigint"))
    side = lambda c: {n: c[n] for n in ("presentation_index", "pt_ns", "gaps")}
    return _summary(j, ranges.columns, count, side(F.col("s._after")), side(F.col("e._before")))


def _runs_of_indices(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Frames in order with the number of breaks in their indices so far."""
    index = rows["presentation_index"]
    breaks = np.ones(len(index), np.int64)
    breaks[1:] = (index[1:] != index[:-1] + 1) | (index[1:] < 0) | (index[:-1] < 0)
    return {"presentation_index": index, "pt_ns": rows["pt_ns"], "gaps": np.cumsum(breaks)}


def _summary(rows: DataFrame, columns: list[str], count: Column, first: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    some = count > 0
    index = lambda c: F.when(some & (c["presentation_index"] >= 0), c["presentation_index"])
    exact = (
        some
        & (first["presentation_index"] >= 0)
        & (first["gaps"] == last["gaps"])
        & (first["pt_ns"] == F.col("start_ns"))
        & (last["pt_ns"] == F.col("end_ns"))
    )
    return rows.select(
        *columns, index(first).alias("first_frame"), index(last).alias("last_frame"), count.alias("known_count"), F.when(exact, count).alias("frame_count")
    )


def first_rows_in_ranges(ranges: DataFrame, rows: DataFrame | Ordered, maximum: int) -> DataFrame:
    """The first ``maximum`` rows of each closed range, in order.

    The range is turned into positions and shortened before the join, so no range ever lists more
    than it returns.
    """
    r = _closed(ranges)
    o = settle(sequence(arrange(rows), names=("_pos", "", "")))
    last = F.least(F.col("p1"), F.col("p0") + F.lit(maximum - 1))
    wanted = (
        sweep.positions(r, o)
        .where("p0 <= p1")
        .withColumn("_pos", F.explode(F.sequence(F.col("p0"), last)))
        .withColumn("ordinal", F.col("_pos") - F.col("p0") + 1)
        .drop("p0", "p1")
    )
    return o.plain().join(wanted, ["media_id", "_pos"]).drop("_pos")
