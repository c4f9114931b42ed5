"""Lookups by position in presentation order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import Ordered, arrange, carry_last, sequence, settle

_BODY = ["presentation_index", "pt_ns", "key_frame"]


def frame_neighbours(frames: DataFrame | Ordered, payload: list[str] = _BODY) -> DataFrame:
    """frames + ``previous`` and ``following`` frame; null at the ends."""
    o = sequence(
        arrange(frames), payload, pos=False, prev=True, next=True, names=("_pos", "previous", "following")
    )
    return o.plain()


def keyframe_neighbours(frames: DataFrame | Ordered, payload: list[str] = _BODY) -> DataFrame:
    """frames + the keyframes strictly before and after, null where there are none."""
    key = F.when(F.col("key_frame"), F.struct(*payload))
    o = settle(carry_last(arrange(frames), key, "previous_key", inclusive=False))
    return carry_last(o, key, "next_key", inclusive=False, reverse=True).plain()


def positions(frames: DataFrame | Ordered) -> DataFrame:
    """frames + dense ``pos`` and the media's last position ``last_pos``."""
    o = sequence(arrange(frames), names=("pos", "", ""))
    counts = o.df.groupBy("media_id").agg((F.count(F.lit(1)) - 1).alias("last_pos"))
    return o.plain().join(counts, "media_id")


def step_frames(steps: DataFrame, frames: DataFrame | Ordered, payload: list[str] = _BODY, most: int | None = None) -> DataFrame:
    """Frame reached by ``step`` signed frames from ``presentation_index``.

    The walk stops at the media's ends, and after ``most`` frames each way if given; where it cannot
    move at all ``reached`` is null.
    """
    rows = positions(frames)
    here = rows.select("media_id", "presentation_index", "pos", "last_pos")
    bounded = F.col("step") if most is None else F.greatest(F.least(F.col("step"), F.lit(most)), F.lit(-most))
    goal = F.greatest(F.least(F.col("pos") + bounded, F.col("last_pos")), F.lit(0))
    there = rows.select("media_id", F.col("pos").alias("_goal"), F.struct("pos", *payload).alias("reached"))
    return (
        steps.join(here, ["media_id", "presentation_index"], "left")
        .withColumn("_goal", F.when(goal != F.col("pos"), goal))
        .join(there, ["media_id", "_goal"], "left")
        .drop("_goal", "last_pos", "pos")
    )


def next_frames(starts: DataFrame, frames: DataFrame | Ordered, payload: list[str] = _BODY) -> DataFrame:
    """The ``count`` frames after each start frame in presentation order, numbered from 1."""
    rows = positions(frames)
    here = rows.select("media_id", "presentation_index", "pos", "last_pos")
    wanted = F.least(F.col("count"), F.col("last_pos") - F.col("pos"))
    there = rows.select("media_id", F.col("pos").alias("_goal"), F.struct(*payload).alias("frame"))
    return (
        starts.join(here, ["media_id", "presentation_index"])
        .where(wanted > 0)
        .withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("bigint"), wanted)))
        .withColumn("_goal", F.col("pos") + F.col("ordinal"))
        .join(there, ["media_id", "_goal"])
        .drop("_goal", "pos", "last_pos")
    )


def contiguity(frames: DataFrame | Ordered) -> DataFrame:
    """frames + ``contiguous``: index + 1, later time and same serial as the frame before.

    The first frame of a media is contiguous when its index is known.
    """
    o = sequence(
        arrange(frames), ["presentation_index", "pt_ns", "serial"], pos=False, prev=True
    )
    p = F.col("_prev")
    follows = (
        (F.col("presentation_index") == p["presentation_index"] + 1)
        & (F.col("pt_ns") > p["pt_ns"])
        & F.col("serial").eqNullSafe(p["serial"])
    )
    known = F.col("presentation_index") >= 0
    ok = F.when(p.isNull(), known).otherwise(follows & known)
    return o.to(o.df.withColumn("contiguous", F.coalesce(ok, F.lit(False)))).plain().drop("_prev")


def locate_frames(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """Time of a frame identity: by index when known, else by (pts, serial) of an unindexed frame."""
    indexed = frames.where(F.col("presentation_index") >= 0).select(
        "media_id", "presentation_index", F.col("pt_ns").alias("_t1")
    )
    rest = frames.where(F.coalesce(F.col("presentation_index") < 0, F.lit(True))).select(
        "media_id", F.col("pts").alias("_p"), F.col("serial").alias("_s"), F.col("pt_ns").alias("_t2")
    )
    rest = rest.groupBy("media_id", "_p", "_s").agg(F.min("_t2").alias("_t2"))
    first = indexed.groupBy("media_id", "presentation_index").agg(F.min("_t1").alias("_t1"))
    out = wanted.join(first, ["media_id", "presentation_index"], "left")
    unindexed = F.coalesce(out["presentation_index"] < 0, F.lit(True))
    match = (
        (out["media_id"] == rest["media_id"])
        & out["pts"].eqNullSafe(rest["_p"])
        & out["serial"].eqNullSafe(rest["_s"])
        & unindexed
    )
    return (
        out.join(rest, match, "left")
        .drop(rest["media_id"])
        .withColumn("time_ns", F.coalesce("_t1", "_t2"))
        .drop("_t1", "_t2", "_p", "_s")
    )
