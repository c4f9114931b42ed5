"""Timeline markers: chapters, scenes, bookmarks and their change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebase import clamp_time, pts_to_ns
from .asof import bracket
from .order import arrange, sequence

FIELDS = ["time_ns", "kind", "label", "category", "note"]


def normalise_chapters(media: DataFrame) -> DataFrame:
    """One row per chapter from ``raw_chapters`` (id, start, end, title, time_base).

    Starts and ends are rescaled to the video time base and its origin, kept inside the media, and
    a missing end is the media's end. Numbered by (start, id); untitled ones get "Chapter n".
    """
    base = F.col("c.time_base")
    video = F.col("time_base")

    def rescaled(ts: Column) -> Column:
        # Through the video time base, as chapter ticks are stored there first.
        zero = F.lit(0).cast("bigint")
        num = F.col("c.time_base.num").cast("decimal(38,0)") * video["den"]
        den = F.col("c.time_base.den").cast("decimal(38,0)") * video["num"]
        twice = F.abs(ts.cast("decimal(38,0)")) * num * 2 + den
        ticks = F.call_function("div", twice, den * 2)
        ticks = F.when(ts < zero, -ticks).otherwise(ticks)
        time = pts_to_ns(ticks, F.col("stream_start_pts"), video)
        return clamp_time(time, F.col("duration_ns"))

    usable = media.select(
        "media_id", "duration_ns", "time_base", "stream_start_pts", F.explode("raw_chapters").alias("c")
    ).where((base["num"] > 0) & (base["den"] > 0))
    start = rescaled(F.col("c.start"))
    fallback = F.when(F.col("duration_ns") > 0, F.col("duration_ns")).otherwise(F.col("start_ns"))
    rows = (
        usable.withColumn("start_ns", start)
        .withColumn(
            "end_ns",
            F.when(F.col("c.end").isNull(), fallback).otherwise(
                F.greatest(rescaled(F.col("c.end")), F.col("start_ns"))
            ),
        )
        .select("media_id", F.col("c.id").alias("chapter_id"), "start_ns", "end_ns", F.col("c.title").alias("title"))
    )
    # A media has a handful of chapters, read from one array of its own row.
    w = Window.partitionBy("media_id").orderBy("start_ns", "chapter_id")
    number = F.row_number().over(w)
    return rows.withColumn("number", number).withColumn(
        "title",
        F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Chapter "), F.col("number"))).otherwise(F.col("title")),
    )


def apply_marker_changes(changes: DataFrame, media: DataFrame) -> DataFrame:
    """Markers after a change log of add, update, remove and clear rows.

    The latest change of a marker decides; ``clear`` (of a kind, or all kinds when null) removes
    what was there before it. An update of a marker that does not exist has no effect. Times are
    kept inside the media and ids stay.
    """
    edits = changes.where(F.col("op").isin("add", "update", "remove"))
    # Lifetimes: each add opens one; removals and later clears close it.
    known = edits.withColumn("_edit", F.struct("change_seq", "op", *FIELDS))
    latest = known.groupBy("media_id", "marker_id").agg(
        F.max("_edit").alias("_last"),
        F.max(F.when(F.col("op") == "add", F.col("change_seq"))).alias("_added"),
        F.max(F.when(F.col("op") == "remove", F.col("change_seq"))).alias("_removed"),
    )
    alive = latest.where(
        F.col("_added").isNotNull()
        & (F.col("_removed").isNull() | (F.col("_removed") < F.col("_added")))
    )
    rows = alive.select("media_id", "marker_id", "_added", "_last.*").drop("op")
    # A clear removes the marker when the kind it has at that moment matches. Each edit holds until
    # the next one; the first clear of its kind behind it is looked up and must fall in between.
    history = known.where(F.col("op") != "remove").select(
        "media_id", "marker_id", F.col("change_seq").alias("_s"), "kind"
    )
    o = sequence(arrange(history, ("media_id", "marker_id"), ("_s",)), ["_s"], pos=False, next=True)
    spans = o.plain().join(alive.select("media_id", "marker_id", "_added"), ["media_id", "marker_id"]).where(
        F.col("_s") >= F.col("_added")
    )
    clears = changes.where(F.col("op") == "clear").select("media_id", "kind", "change_seq")
    around = bracket(
        spans.select("media_id", "kind", "_s"), clears, [], ("media_id", "kind"), "_s", ("change_seq",), strict=True
    )
    until = F.col("_next._s")
    within = F.col("after.change_seq").isNotNull() & (until.isNull() | (F.col("after.change_seq") < until))
    by_kind = spans.join(around, ["media_id", "kind", "_s"]).where(within).select("media_id", "marker_id")
    cleared = clears.where("kind is null").groupBy("media_id").agg(F.max("change_seq").alias("_all"))
    by_all = alive.join(cleared, "media_id").where(F.col("_all") > F.col("_added")).select("media_id", "marker_id")
    gone = by_kind.unionByName(by_all).distinct()
    durations = media.select("media_id", F.col("duration_ns").alias("_d"))
    return (
        rows.join(gone, ["media_id", "marker_id"], "left_anti")
        .join(durations, "media_id")
        .withColumn("time_ns", clamp_time(F.col("time_ns"), F.col("_d")))
        .select("media_id", "marker_id", *FIELDS)
    )


def scene_markers(detections: DataFrame) -> DataFrame:
    """Markers "Scene n" from detected scenes, numbered in time order."""
    o = arrange(detections.where(F.col("kind") == "scene"), order=("start_ns", "first_frame"))
    o = sequence(o, names=("_n", "", ""))
    return o.plain().select(
        "media_id",
        (F.col("_n") + 1).alias("number"),
        F.col("start_ns").alias("time_ns"),
        F.lit("scene").alias("kind"),
        F.concat(F.lit("Scene "), F.col("_n") + 1).alias("label"),
        F.lit("").alias("category"),
        F.lit("").alias("note"),
    )


def chapter_markers(chapters: DataFrame) -> DataFrame:
    return chapters.select(
        "media_id",
        F.col("number").cast("bigint").alias("number"),
        F.col("start_ns").alias("time_ns"),
        F.lit("chapter").alias("kind"),
        F.col("title").alias("label"),
        F.lit("Chapter").alias("category"),
        F.lit("").alias("note"),
    )


def all_markers(bookmarks: DataFrame, chapters: DataFrame, detections: DataFrame) -> DataFrame:
    """Bookmarks, chapters and the latest detected scenes as one marker table.

    Bookmarks keep their ids; chapters and scenes are numbered after the largest of them.
    """
    kept = bookmarks.where(~F.col("kind").isin("scene", "chapter")).select("media_id", "marker_id", *FIELDS)
    made = chapter_markers(chapters).unionByName(scene_markers(detections))
    top = kept.groupBy("media_id").agg(F.max("marker_id").alias("_top"))
    count = chapters.groupBy("media_id").agg(F.count(F.lit(1)).alias("_chapters"))
    placed = made.join(top, "media_id", "left").join(count, "media_id", "left")
    shift = F.when(F.col("kind") == "scene", F.coalesce("_chapters", F.lit(0))).otherwise(F.lit(0))
    ids = F.coalesce("_top", F.lit(0)) + shift + F.col("number")
    return kept.unionByName(placed.withColumn("marker_id", ids).select("media_id", "marker_id", *FIELDS))


def distinct_targets(targets: DataFrame, media: DataFrame, time: str = "time_ns") -> DataFrame:
    """Distinct target times per media, kept inside the media."""
    d = media.select("media_id", F.col("duration_ns").alias("_d"))
    return (
        targets.join(d, "media_id")
        .select("media_id", clamp_time(F.col(time), F.col("_d")).alias(time))
        .distinct()
    )
