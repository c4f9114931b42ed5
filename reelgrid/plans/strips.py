"""Small frame samples: evenly over a range, or around a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MS
from ..functions.spacing import div, evenly_spaced
from ..operators import lookups
from ..operators.asof import asof, known_frame_hint
from ..operators.order import Ordered, arrange, running_sum, sequence, settle

MIN_COUNT = 1
DEFAULT_SPACING_NS = 40 * MS
SPACING_ROWS = 129


def _counted(plans: DataFrame, most: int | None) -> tuple[DataFrame, Column]:
    """Plans and how many targets each gets; with ``most``, plans say whether theirs were cut to it."""
    count = F.greatest(F.col("count"), F.lit(MIN_COUNT))
    if most is None:
        return plans, count
    return plans.withColumn("cut", F.col("count") > most), F.least(count, F.lit(most))


def _spread(start: Column, end: Column, count: Column) -> Column:
    """Distinct target times over [start, end]; a single one is the midpoint."""
    middle = F.when(end > start, start + div(end - start, 2)).otherwise(start)
    return F.when((count == 1) | (end <= start), F.array(middle)).otherwise(
        F.array_distinct(evenly_spaced(start, end, count))
    )


def _exploded(plans: DataFrame, targets: str, probe: Column) -> DataFrame:
    """One row per target with its ordinal; ``current`` is the first target closest to the probe."""
    gaps = F.transform(F.col(targets), lambda t, i: F.struct(F.abs(F.greatest(t, F.lit(0)) - F.greatest(probe, F.lit(0))).alias("gap"), i.alias("i")))
    return (
        plans.withColumn("_nearest", F.array_min(gaps)["i"])
        .select("*", F.posexplode(targets).alias("ordinal", "target_ns"))
        .withColumn("current", F.col("ordinal") == F.col("_nearest"))
        .drop(targets, "_nearest")
    )


def _hinted(plans: DataFrame, targets: str, probe: Column, frames: DataFrame | Ordered, few: bool | None = None) -> DataFrame:
    """One row per target with its ordinal and the index of its nearest frame, and its key flag where the times are equal."""
    if not lookups.even(plans, frames, targets, few):
        return known_frame_hint(_exploded(plans, targets, probe), frames)
    gaps = F.transform(F.col(targets), lambda t, i: F.struct(F.abs(F.greatest(t, F.lit(0)) - F.greatest(probe, F.lit(0))).alias("gap"), i.alias("i")))
    found = lookups.nearest_frames(plans.withColumn("_nearest", F.array_min(gaps)["i"]), frames, ["key_frame"], targets)
    return found.withColumns(
        {
            "ordinal": F.col("ordinal").cast("int"),
            "current": F.col("ordinal") == F.col("_nearest"),
            "index_hint": F.col("hit.presentation_index"),
            "key_hint": F.when(F.col("hit.pt_ns") == F.col("target_ns"), F.col("hit.key_frame")),
        }
    ).drop("_nearest", "hit")


def even_sample(requests: DataFrame, frames: DataFrame | Ordered, most: int | None = None, few: bool | None = None) -> DataFrame:
    """``count`` (at least 1) targets over each range with their nearest frames.

    requests: request_id, media_id, start_ns, end_ns, count, probe_ns. With ``most`` no range gets more
    targets than that, and ``cut`` tells which asked for more. ``few`` tells that no media has many targets where
    the caller has counted them.
    """
    counted, count = _counted(requests, most)
    r = counted.withColumn("_targets", _spread(F.col("start_ns"), F.col("end_ns"), count))
    return _hinted(r, "_targets", F.col("probe_ns"), frames, few)


def _known(frames: DataFrame | Ordered) -> Ordered:
    """Frames with position, running count of breaks in the index sequence, and media size."""
    o = settle(sequence(arrange(frames), ["presentation_index", "pt_ns", "serial"], prev=True))
    p = F.col("_prev")
    follows = (
        (F.col("presentation_index") >= 0)
        & (F.col("presentation_index") == p["presentation_index"] + 1)
        & (F.col("pt_ns") > p["pt_ns"])
        & F.col("serial").eqNullSafe(p["serial"])
    )
    broken = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1).cast("bigint")
    return settle(running_sum(o.to(o.df.withColumn("_b", broken).drop("_prev")), F.col("_b"), "_breaks"))


def local_spacing(probes: DataFrame, known: DataFrame) -> DataFrame:
    """probes (with the nearest frame's ``_p`` and ``_dur``) + ``spacing_ns``.

    The nearest frame's own duration where positive; else the upper median of the positive
    durations of up to 129 frames around it; else 40 ms.
    """
    own = probes.where(F.col("_dur") > 0).select("probe_id", "media_id", F.col("_dur").alias("spacing_ns"))
    start = F.greatest(F.col("_p") - SPACING_ROWS // 2, F.lit(0))
    around = (
        probes.where(F.coalesce(F.col("_dur") <= 0, F.lit(True)) & F.col("_p").isNotNull())
        .select("probe_id", "media_id", F.explode(F.sequence(start, start + SPACING_ROWS - 1)).alias("_at"))
        .join(
            known.where(F.col("duration_ns") > 0).select("media_id", F.col("_pos").alias("_at"), "duration_ns"),
            ["media_id", "_at"],
        )
        .groupBy("probe_id", "media_id")
        .agg(F.sort_array(F.collect_list("duration_ns")).alias("_d"))
        .select("probe_id", "media_id", F.get("_d", F.call_function("div", F.size("_d"), F.lit(2)).cast("int")).alias("spacing_ns"))
    )
    return probes.join(own.unionByName(around), ["probe_id", "media_id"], "left").withColumn(
        "spacing_ns", F.coalesce("spacing_ns", F.lit(DEFAULT_SPACING_NS).cast("bigint"))
    )


def context_window(probes: DataFrame, frames: DataFrame | Ordered, media: DataFrame, most: int | None = None) -> DataFrame:
    """``count`` targets around each probe time.

    The exact neighbouring frames when that many follow each other without a gap, else times spaced
    by the local frame spacing and kept inside the media. probes: probe_id, media_id, target_ns,
    count (cut to ``most`` and so told in ``cut``, if given). Result has ``exact`` and per target its
    ordinal, time, hints and ``current``.
    """
    probes, count = _counted(probes, most)
    o = _known(frames)
    known = o.plain()
    n = count.cast("bigint")
    near = asof(probes, o, ["_pos", "duration_ns"], "nearest")
    totals = known.groupBy("media_id").agg(F.count(F.lit(1)).alias("_total"))
    d = media.select("media_id", F.col("duration_ns").alias("_media_ns"))
    p = (
        near.withColumns({"_p": F.col("hit._pos"), "_dur": F.col("hit.duration_ns"), "_n": n})
        .drop("hit")
        .join(totals, "media_id", "left")
        .join(d, "media_id")
    )
    start = F.least(F.greatest(F.col("_p") - div(F.col("_n"), 2), F.lit(0)), F.col("_total") - F.col("_n"))
    p = p.withColumn("_start", F.when(F.col("_total") >= F.col("_n"), start))
    at = known.select("media_id", F.col("_pos").alias("_start"), F.col("_breaks").alias("_b0"), F.col("presentation_index").alias("_i0"))
    to = known.select("media_id", F.col("_pos").alias("_stop"), F.col("_breaks").alias("_b1"))
    p = (
        p.withColumn("_stop", F.col("_start") + F.col("_n") - 1)
        .join(at, ["media_id", "_start"], "left")
        .join(to, ["media_id", "_stop"], "left")
        .withColumn("exact", F.coalesce((F.col("_b0") == F.col("_b1")) & (F.col("_i0") >= 0), F.lit(False)))
    )
    cells = (
        p.where("exact")
        .select("probe_id", "media_id", "_start", F.explode(F.sequence("_start", "_stop")).alias("_at"))
        .join(known.select("media_id", F.col("_pos").alias("_at"), "pt_ns"), ["media_id", "_at"])
        .groupBy("probe_id", "media_id")
        .agg(F.sort_array(F.collect_list("pt_ns")).alias("_targets"))
    )
    base = [c for c in probes.columns if c != "count"]
    exact = p.where("exact").select(*base, "exact").join(cells, ["probe_id", "media_id"])
    loose = local_spacing(p.where("not exact"), known)
    one = F.lit(1).cast("bigint")
    gap = F.greatest(F.col("spacing_ns"), one)
    steps = F.col("_n") - 1
    # Saturating products, as spacing * count may leave BIGINT.
    top = F.lit(2**63 - 1)
    span = F.when(steps <= 0, F.lit(0)).when(gap > div(top, F.greatest(steps, one)), top).otherwise(gap * F.least(steps, div(top, gap)))
    half = div(F.col("_n"), 2)
    before = F.when(half <= 0, F.lit(0)).when(gap > div(top, F.greatest(half, one)), top).otherwise(gap * F.least(half, div(top, gap)))
    total = F.col("_media_ns")
    begin = F.least(F.when(F.col("target_ns") > before, F.col("target_ns") - before).otherwise(F.lit(0)), total - span)
    loose = loose.withColumns({"_span": span, "_begin": begin})
    spaced = F.transform(
        F.sequence(F.lit(0).cast("bigint"), steps), lambda i: F.col("_begin") + F.greatest(F.col("spacing_ns"), one) * i
    )
    targets = (
        F.when(F.col("_n") == 1, F.array("target_ns"))
        .when(F.col("_span") >= total, _spread(F.lit(0).cast("bigint"), total, F.col("_n")))
        .otherwise(spaced)
    )
    loose = loose.withColumn("_targets", targets).select(*base, "exact", "_targets")
    plans = exact.select(*base, "exact", "_targets").unionByName(loose).withColumnRenamed("target_ns", "probe_ns")
    return _hinted(plans, "_targets", F.col("probe_ns"), frames if isinstance(frames, Ordered) else known)
