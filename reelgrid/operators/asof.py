"""As-of and nearest lookups by time.

Distinct probe times and rows are united and put in one order; the latest row seen in either
direction answers each probe. One shuffle, linear in rows + probes, no range join. The answers
are joined back to the probes, so many probes at one time cost one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FRAME_ORDER, MS
from .order import Ordered, arrange, carry_last, sequence, settle, small_groups

DEFAULT_TOLERANCE_NS = 500 * MS
_SIDE, _AT = "_side", "_at"


def bracket(
    probes: DataFrame,
    rows: DataFrame | Ordered,
    payload: list[str],
    keys: tuple[str, ...] = ("media_id",),
    target: str = "target_ns",
    order: tuple[str, ...] = FRAME_ORDER,
    strict: bool = False,
    sides: tuple[str, ...] = ("before", "after"),
    few: bool | None = None,
) -> DataFrame:
    """keys, target, before, after: the rows around every distinct probe time.

    ``before`` is the last row at or before the target, ``after`` the first at or after it
    (``strict`` leaves out rows exactly at the target). Both are structs of order + payload. Each
    costs a sort of the united rows; ``sides`` names those that are needed. ``few`` tells that no
    group has many probes where the caller has counted them.
    """
    chunked = isinstance(rows, Ordered) and rows.split
    source = rows.plain() if isinstance(rows, Ordered) else rows
    names = list(dict.fromkeys([*order, *payload]))
    body = F.struct(*names)
    row_part = source.where(F.col(order[0]).isNotNull()).select(
        *keys, F.col(order[0]).alias(_AT), body.alias("row")
    )
    probe_part = (
        probes.where(F.col(target).isNotNull()).select(*keys, F.col(target).alias(_AT)).distinct()
    )
    both = row_part.withColumn(_SIDE, F.lit(0)).unionByName(
        probe_part.withColumn(_SIDE, F.lit(1)), allowMissingColumns=True
    )
    # Rows that count for a probe at an equal time must come earlier in the scan direction.
    side = F.col(_SIDE)
    ahead = both.withColumn("_rank", (1 - side) if strict else side)
    ranking = (_AT, "_rank", "row")
    if isinstance(rows, Ordered) and not chunked and (few or small_groups(probes, keys)):
        ordered = Ordered(ahead, tuple(keys), ranking)
    else:
        ordered = arrange(ahead, keys, ranking)
    if "before" in sides:
        ordered = carry_last(ordered, F.col("row"), "before")
    if "after" in sides:
        ordered = settle(ordered) if "before" in sides else ordered
        back = ordered.to(ordered.df.withColumn("_rank", -F.col("_rank")))
        ordered = carry_last(back, F.col("row"), "after", reverse=True)
    return ordered.df.where(F.col(_SIDE) == 1).select(*keys, F.col(_AT).alias(target), *sides)


def range_ends(
    ranges: DataFrame,
    rows: Ordered,
    payload: list[str],
    start: str = "start_ns",
    end: str = "end_ns",
    keys: tuple[str, ...] = ("media_id",),
    order: tuple[str, ...] = FRAME_ORDER,
) -> DataFrame:
    """keys, start, end, first, last, past: rows at the two ends of every distinct range.

    ``first`` is the first row at or after the start, ``last`` the last at or before the end, ``past``
    the last row before the start. Every row carries its follower, so one order and one scan of rows and
    both ends answer all three; an opening row before all others stands for the media's beginning.
    """
    names = list(dict.fromkeys([*order, *payload]))
    body = F.struct(*names)
    source = sequence(rows, names, pos=False, prev=True, next=True, names=("", "_lead", "_follow")).plain()
    source = source.where(F.col(order[0]).isNotNull()).withColumn("_body", body)
    itself = F.struct(F.col(order[0]).alias(_AT), F.lit(0).alias("_rank"), F.col("_body").alias("row"), F.col("_follow").alias("next"))
    absent = F.when(F.lit(False), F.col("_body"))
    opening = F.struct(F.lit(-(2**63)).alias(_AT), F.lit(-2).alias("_rank"), absent.alias("row"), F.col("_body").alias("next"))
    opens = F.col(f"_lead.{order[0]}").isNull()
    row_part = source.select(*keys, F.inline(F.when(opens, F.array(opening, itself)).otherwise(F.array(itself))))
    wanted = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end).distinct()
    at_start = F.struct(F.col(start).alias(_AT), F.lit(-1).alias("_rank"))
    at_end = F.struct(F.col(end).alias(_AT), F.lit(1).alias("_rank"))
    probes = wanted.select(*keys, start, end, F.inline(F.array(at_start, at_end)))
    both = row_part.unionByName(probes, allowMissingColumns=True)
    ranking = (_AT, "_rank", "row")
    if not rows.split and small_groups(wanted, keys):
        ordered = Ordered(both, tuple(keys), ranking)
    else:
        ordered = arrange(both, keys, ranking)
    known = F.when(F.col(start).isNull(), F.struct("row", "next"))
    seen = carry_last(ordered, known, "_seen").df.where(F.col(start).isNotNull())
    begins = F.col("_rank") == -1
    return seen.groupBy(*keys, start, end).agg(
        F.max(F.when(begins, F.col("_seen.next"))).alias("first"),
        F.max(F.when(~begins, F.col("_seen.row"))).alias("last"),
        F.max(F.when(begins, F.col("_seen.row"))).alias("past"),
    )


def nearest_of(before: Column, after: Column, target: Column, time: str = FRAME_ORDER[0]) -> Column:
    """Exact hit first, else the closer row; the earlier one on a tie; either end alone."""
    return (
        F.when(after.isNull(), before)
        .when(before.isNull() | (after[time] == target), after)
        .when(target - before[time] <= after[time] - target, before)
        .otherwise(after)
    )


def by_bias(before: Column, after: Column, target: Column, bias: Column | str) -> Column:
    """at_or_before, at_or_after (past the end: the final row) or nearest."""
    bias = F.lit(bias) if isinstance(bias, str) else bias
    return (
        F.when(bias == "at_or_before", before)
        .when(bias == "at_or_after", F.coalesce(after, before))
        .otherwise(nearest_of(before, after, target))
    )


def asof(
    probes: DataFrame,
    rows: DataFrame | Ordered,
    payload: list[str],
    bias: Column | str = "nearest",
    keys: tuple[str, ...] = ("media_id",),
    target: str = "target_ns",
    name: str = "hit",
) -> DataFrame:
    """Probes + ``hit``: the frame a seek to ``target`` with this bias shows, or null."""
    if isinstance(bias, str) and bias == "at_or_before":
        before = bracket(probes, rows, payload, keys, target, sides=("before",))
        return probes.join(before.withColumnRenamed("before", name), [*keys, target], "left")
    around = bracket(probes, rows, payload, keys, target)
    joined = probes.join(around, [*keys, target], "left")
    hit = by_bias(F.col("before"), F.col("after"), F.col(target), bias)
    return joined.withColumn(name, hit).drop("before", "after")


def nearest_sample(
    probes: DataFrame,
    samples: DataFrame | Ordered,
    payload: list[str],
    target: str = "target_ns",
    hint: str = "index_hint",
    tolerance: str = "tolerance_ns",
    name: str = "hit",
) -> DataFrame:
    """Nearest sample within a tolerance that agrees with an optional index hint.

    Order of preference: near and of the hinted (or an unknown) index; the sample of exactly the
    hinted index; the near one whatever its index; null.
    """
    names = list(dict.fromkeys([*FRAME_ORDER, *payload]))
    source = samples.plain() if isinstance(samples, Ordered) else samples
    near = asof(probes, samples, payload, "nearest", target=target, name="_near")
    wanted = probes.where(F.col(hint) >= 0).select("media_id", F.col(hint).alias("_h")).distinct()
    exact = (
        source.join(wanted, (source["media_id"] == wanted["media_id"]) & (source["presentation_index"] == wanted["_h"]), "left_semi")
        .groupBy("media_id", F.col("presentation_index").alias(hint))
        .agg(F.min(F.struct(*names)).alias("_exact"))
    )
    gap = F.abs(F.col("_near")["pt_ns"] - F.col(target))
    close = gap <= F.coalesce(F.col(tolerance), F.lit(DEFAULT_TOLERANCE_NS))
    index = F.col("_near")["presentation_index"]
    hinted = F.coalesce(F.col(hint) >= 0, F.lit(False))
    agrees = ~hinted | index.isNull() | (index < 0) | (index == F.col(hint))
    hit = (
        F.when(close & agrees, F.col("_near"))
        .when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(close, F.col("_near"))
    )
    return near.join(exact, ["media_id", hint], "left").withColumn(name, hit).drop("_near", "_exact")


def known_frame_hint(
    probes: DataFrame, frames: DataFrame | Ordered, target: str = "target_ns"
) -> DataFrame:
    """Index of the nearest known frame; its key flag only where the times are equal."""
    near = asof(probes, frames, ["key_frame"], "nearest", target=target, name="_near")
    return near.withColumns(
        {
            "index_hint": F.col("_near.presentation_index"),
            "key_hint": F.when(F.col("_near.pt_ns") == F.col(target), F.col("_near.key_frame")),
        }
    ).drop("_near")


def attach_scores(frames: DataFrame, samples: DataFrame | Ordered, payload: list[str]) -> DataFrame:
    """Delivered frames with the scores of their samples (left, nearest with tolerance)."""
    probes = frames.withColumns(
        {"index_hint": F.col("presentation_index"), "tolerance_ns": F.lit(DEFAULT_TOLERANCE_NS)}
    )
    hit = nearest_sample(probes, samples, payload, target="pt_ns")
    return hit.select(*frames.columns, *[F.col("hit")[c].alias(c) for c in payload])


def adjacent_marker(
    probes: DataFrame, markers: DataFrame, target: str = "target_ns", forward: Column | None = None
) -> DataFrame:
    """Previous and next marker time of the probe's kind, strictly before and after the target.

    With ``forward`` (boolean column) the wanted one is also given as ``adjacent_ns``.
    """
    around = bracket(
        probes, markers, [], ("media_id", "kind"), target, ("time_ns", "marker_id"), strict=True
    )
    out = probes.join(around, ["media_id", "kind", target], "left").withColumns(
        {"previous_ns": F.col("before.time_ns"), "next_ns": F.col("after.time_ns")}
    )
    if forward is not None:
        out = out.withColumn("adjacent_ns", F.when(forward, F.col("next_ns")).otherwise(F.col("previous_ns")))
    return out.drop("before", "after")
