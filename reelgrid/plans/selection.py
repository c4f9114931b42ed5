"""Which frames a request selects: ranges, keyframes, targets and single frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from ..functions.spacing import div, evenly_spaced
from ..functions.scores import high_motion
from ..operators import lookups, sweep
from ..operators.asof import asof
from ..operators.order import Ordered, arrange, running_sum, sequence, settle
from ..session import materialise

BODY = ["presentation_index", "pts", "pt_ns", "key_frame"]
FIRST = -(2**63)


def _swept(requests: DataFrame, frames: DataFrame | Ordered) -> tuple[DataFrame, DataFrame]:
    """Frames with position and the number of keyframes before each, and requests with the first and last
    position and key ordinals of their range: one sweep, stored once as both come from it."""
    r = requests.withColumn("_from", F.when(F.col("range_start_ns") <= 0, F.lit(FIRST)).otherwise(F.col("range_start_ns")))
    spans = r.select("media_id", F.col("_from").alias("start_ns"), F.col("range_end_ns").alias("end_ns")).distinct()
    key = F.when(F.col("_row.key_frame"), 1).otherwise(0)
    o = sweep.counted(sweep.counted(sweep.events(spans, frames, BODY), F.lit(1), "_n"), key, "_k")
    o = o.to(materialise(sweep.before(o, key, "_key").df))
    rows = o.df.where(sweep.is_row()).select("media_id", "_row.*", (F.col("_n") - 1).alias("_pos"), (F.col("_k") - key).alias("_keys"))
    totals = o.df.groupBy("media_id").agg(F.max("_n").alias("_total"))
    ends = sweep.paired(o, ["_n", "_k", "_key"], ["_n", "_k"]).join(totals, "media_id").where("_total > 0")
    # Past the last frame a range starts with that frame.
    past = F.when(F.col("s._n") == F.col("_total"), 1).otherwise(0)
    bounds = ends.select(
        "media_id", F.col("start_ns").alias("_from"), F.col("end_ns").alias("range_end_ns"),
        (F.col("s._n") - past).alias("_p0"), (F.col("e._n") - 1).alias("_p1"),
        (F.col("s._k") - past * F.coalesce("s._key", F.lit(0))).alias("_k0"), F.col("e._k").alias("_k1"),
    )
    return rows, r.join(bounds, ["media_id", "_from", "range_end_ns"]).drop("_from")


def _picks(asked: pa.Table, held: lookups.Frames, keyframes: bool) -> tuple[np.ndarray, ...]:
    """Of each request: the first pick, the step, how many frames match and the most it takes; picks are places in the
    frames, or in the keyframes, which are given as places in the frames."""
    number = lambda c, absent: lookups._whole(asked.column(c).chunk(0) if asked.num_rows else pa.array([], pa.int64()), absent)
    known = lambda c: asked.column(c).is_valid().to_numpy()
    start, most = number("range_start_ns", FIRST), np.where(known("max_frames"), number("max_frames", 0), 2**62)
    first = held.place(np.where(start <= 0, FIRST, start))
    last = held.place(number("range_end_ns", 0), past=True) - 1
    # Past the last frame a range starts with that frame.
    first = np.minimum(first, held.end - 1)
    some = (held.end > held.begin) & (first <= last) & known("range_end_ns")
    first, last = np.where(some, first, 0), np.where(some, last, -1)
    if keyframes:
        key = held.whole("key_frame", 0)
        before = np.concatenate([[0], np.cumsum(key)])
        return before[first], np.ones(len(first), np.int64), np.where(some, before[last + 1] - before[first], 0), most, np.flatnonzero(key)
    step = number("every_n", 0)
    found = np.where(some & (step > 0), (last - first) // np.maximum(step, 1) + 1, 0)
    return first, step, found, most, np.arange(len(held.times))


def _limit_reached(asked: pa.Table, found: np.ndarray, most: np.ndarray) -> pa.Array:
    return pa.array(found > most, mask=~asked.column("max_frames").is_valid().to_numpy())


def range_plan(
    requests: DataFrame, frames: DataFrame | Ordered, keyframes: bool = False, keep: tuple[str, ...] = (), few: bool | None = None
) -> DataFrame:
    """Frames of a range export: from the first frame at or after the start to the range end,
    every N-th of them (or the keyframes), at most ``max_frames``.

    The positions wanted follow from the two range ends, so the frames are joined on equal
    positions; ``limit_reached`` tells that more would have matched. Requests: request_id,
    media_id, range_start_ns, range_end_ns, every_n, max_frames; those in ``keep`` are given too. ``few``
    tells that no media has many requests where the caller has counted them.
    """
    if lookups.even(requests, frames, few=few):
        return _listed(requests, frames, keyframes, keep)
    rows, b = _swept(requests, frames)
    if keyframes:
        found = F.col("_k1") - F.col("_k0")
        start, step = F.col("_k0"), F.lit(1)
        source = rows.where("key_frame").withColumnRenamed("_keys", "_at")
    else:
        found = div(F.col("_p1") - F.col("_p0"), F.col("every_n")) + 1
        start, step = F.col("_p0"), F.col("every_n")
        source = rows.withColumnRenamed("_pos", "_at")
    b = b.where(F.col("_p0") <= F.col("_p1")).withColumn("_found", found.cast("bigint")).where("_found > 0")
    wanted = F.least(F.col("_found"), F.col("max_frames")).cast("bigint")
    picked = (
        b.withColumn("limit_reached", F.col("_found") > F.col("max_frames"))
        .withColumn("seq", F.explode(F.sequence(F.lit(1).cast("bigint"), wanted)))
        .withColumn("_at", start + (F.col("seq") - 1) * step)
        .select("request_id", "media_id", "seq", "_at", "limit_reached", *keep)
    )
    return picked.join(source.select("media_id", "_at", *BODY), ["media_id", "_at"]).drop("_at")


def _listed(requests: DataFrame, frames: DataFrame | Ordered, keyframes: bool, keep: tuple[str, ...]) -> DataFrame:
    """``range_plan`` where each media fits one task: no pick is joined to its frame."""
    given = ["request_id", "media_id", *keep]
    slim = requests.select(*given, "range_start_ns", "range_end_ns", "every_n", "max_frames")

    def answer(asked: pa.Table, held: lookups.Frames) -> Iterator[pa.Table]:
        first, step, found, most, places = _picks(asked, held, keyframes)
        reached, wanted = _limit_reached(asked, found, most), np.maximum(np.minimum(found, most), 0)
        total = np.cumsum(wanted)
        a = 0
        while a < len(wanted):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + lookups.AT_ONCE, "right")))
            owner = np.repeat(np.arange(a, b), wanted[a:b])
            seq = np.arange(len(owner)) - np.searchsorted(owner, owner)
            rows = held.rows.take(pa.array(places[first[owner] + seq * step[owner]]))
            columns = {c: asked.column(c).take(pa.array(owner)) for c in given}
            yield pa.table(columns | {"seq": pa.array(seq + 1), "limit_reached": reached.take(pa.array(owner))} | {c: rows.field(c) for c in BODY})
            a = b

    types = (frames.df if isinstance(frames, Ordered) else frames).schema
    added = [StructField("seq", LongType()), StructField("limit_reached", BooleanType()), *[StructField(c, types[c].dataType) for c in BODY]]
    return lookups.looked_up(slim, frames, BODY, answer, added, ("range_start_ns", "range_end_ns", "every_n", "max_frames"))


def every_nth(rows: DataFrame | Ordered, n: int) -> DataFrame:
    """Rows whose position in the media is a multiple of n."""
    o = sequence(arrange(rows), names=("_pos", "", ""))
    return o.to(o.df.where(F.col("_pos") % max(1, n) == 0).drop("_pos")).plain()


def drop_repeats(hits: DataFrame, keys: list[str], target: str = "target_ns", frame: str = "hit") -> DataFrame:
    """One row per frame of consecutive targets that resolve to it, at its first target.

    Targets in order resolve to frames in order, so equal neighbours are equal frames.
    """
    f = F.col(frame)
    # Frames with an index are the same by index, others by time and pts.
    indexed = F.coalesce(f["presentation_index"] >= 0, F.lit(False))
    identity = F.when(indexed, F.struct(f["presentation_index"].alias("i"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("p"))).otherwise(
        F.struct(F.lit(None).cast("bigint").alias("i"), f["pt_ns"].alias("t"), f["pts"].alias("p"))
    )
    return (
        hits.where(f.isNotNull())
        .withColumn("_id", identity)
        .groupBy(*keys, "_id")
        .agg(F.min(target).alias(target), F.min_by(frame, target).alias(frame))
        .drop("_id")
    )


def target_plan(requests: DataFrame, frames: DataFrame | Ordered, few: bool | None = None) -> DataFrame:
    """Frames nearest to the target times of each request, repeats left out, numbered from 1.

    ``few`` tells that no media has many target times where the caller has counted them.
    """
    if lookups.even(requests, frames, "target_times", few):
        slim = requests.select("request_id", "media_id", "target_times")
        kept = lookups.nearest_frames(slim, frames, BODY, "target_times", repeats=False)
        return kept.select("request_id", "media_id", (F.col("ordinal") + 1).alias("seq"), "target_ns", *[F.col("hit")[c].alias(c) for c in BODY])
    targets = requests.select("request_id", "media_id", F.explode("target_times").alias("target_ns")).distinct()
    hits = asof(targets, frames, BODY, "nearest")
    kept = drop_repeats(hits, ["request_id", "media_id"])
    # The targets of one request came in one array, so they fit one task.
    w = Window.partitionBy("request_id", "media_id").orderBy("target_ns")
    return kept.withColumn("seq", F.row_number().over(w).cast("bigint")).select(
        "request_id", "media_id", "seq", "target_ns", *[F.col("hit")[c].alias(c) for c in BODY]
    )


def scene_targets(detections: DataFrame) -> DataFrame:
    """Distinct scene starts per media: the targets of a scene-frame plan."""
    return detections.where(F.col("kind") == "scene").select("media_id", F.col("start_ns").alias("target_ns")).distinct()


def high_motion_targets(samples: DataFrame | Ordered, threshold: float = 0.70) -> DataFrame:
    """Times of all samples at or above a motion threshold."""
    rows = samples.df if isinstance(samples, Ordered) else samples
    return rows.where(high_motion(F.col("motion"), threshold)).select("media_id", F.col("pt_ns").alias("target_ns")).distinct()


def media_target_plan(targets: DataFrame, frames: DataFrame | Ordered) -> DataFrame:
    """Frames nearest to the targets (media_id, target_ns) of whole media, numbered from 1."""
    hits = asof(targets.distinct(), frames, BODY, "nearest")
    kept = drop_repeats(hits, ["media_id"])
    o = sequence(arrange(kept.select("media_id", "target_ns", *[F.col("hit")[c].alias(c) for c in BODY]), order=("target_ns",)), names=("_n", "", ""))
    return o.plain().withColumn("seq", F.col("_n") + 1).drop("_n")


def single_frame(requests: DataFrame, frames: DataFrame | Ordered) -> DataFrame:
    """Frame nearest to the anchor, or the one before or after it; null where there is none."""
    o = settle(sequence(arrange(frames), BODY, pos=False, prev=True, next=True, names=("", "_before", "_after")))
    probes = requests.withColumn("target_ns", F.when(F.col("anchor_ns") <= 0, F.lit(FIRST)).otherwise(F.col("anchor_ns")))
    hits = asof(probes, o, [*BODY, "_before", "_after"], "nearest")
    h = F.col("hit")
    here = F.struct(*[h[c].alias(c) for c in BODY])
    frame = (
        F.when(F.col("relative") == "previous", h["_before"])
        .when(F.col("relative") == "next", h["_after"])
        .otherwise(F.when(h.isNotNull(), here))
    )
    return hits.withColumn("frame", frame).drop("hit", "target_ns")


def subsample(times: Column, count: Column) -> Column:
    """The array itself when short enough, else ``count`` of its elements, evenly spaced."""
    last = F.size(times) - 1
    positions = evenly_spaced(F.lit(0), last, count)
    return F.when(F.size(times) <= count, times).otherwise(
        F.transform(positions, lambda p: F.get(times, F.least(p, last.cast("bigint")).cast("int")))
    )
