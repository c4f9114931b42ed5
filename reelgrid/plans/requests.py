"""Export requests: normalisation and estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import sanitize_base_name
from ..functions.timebase import clamp_time, ordered_range

@dataclass(frozen=True)
class RequestLimits:
    """Upper bounds that a service may set on requests. Only the size of a sheet is bounded by default."""

    frames: int | None = None
    step: int | None = None
    side_cells: int | None = 32
    cells: int | None = 1_024


def _within(value: Column, low: int, high: int | None) -> Column:
    return F.greatest(value if high is None else F.least(value, F.lit(high)), F.lit(low))


def normalise_requests(requests: DataFrame, media: DataFrame, limits: RequestLimits = RequestLimits()) -> DataFrame:
    """Requests with every field brought into its bounds.

    An empty range runs to the end of the media; target times become distinct, sorted and inside the
    media and no more than the request's own ``max_frames``.
    """
    d = F.col("_d")
    joined = requests.join(media.select("media_id", F.col("duration_ns").alias("_d")), "media_id", "left")
    start, end = ordered_range(F.col("range_start_ns"), F.col("range_end_ns"), d)
    joined = joined.withColumns({"_s": start, "_e": end})
    end = F.when((F.col("_s") == F.col("_e")) & (d > F.col("_s")), d).otherwise(F.col("_e"))
    limit = _within(F.col("max_frames"), 1, limits.frames)
    targets = F.array_sort(
        F.array_distinct(F.transform(F.coalesce("target_times", F.array().cast("array<bigint>")), lambda t: clamp_time(t, d)))
    )
    s = F.col("sheet")
    rows, columns = (_within(s[side], 1, limits.side_cells) for side in ("rows", "columns"))
    room = rows * columns if limits.cells is None else F.least(rows * columns, F.lit(limits.cells))
    cells = F.greatest(F.least(s["frame_count"], room), F.lit(1))
    sheet = F.struct(
        s["source"].alias("source"),
        rows.alias("rows"),
        columns.alias("columns"),
        cells.alias("frame_count"),
        _within(s["cell_w"], 64, 1920).alias("cell_w"),
        _within(s["cell_h"], 48, 1080).alias("cell_h"),
        s["with_time"].alias("with_time"),
        s["with_index"].alias("with_index"),
    )
    return joined.withColumns(
        {
            "anchor_ns": clamp_time(F.col("anchor_ns"), d),
            "range_start_ns": F.col("_s"),
            "range_end_ns": end,
            "every_n": _within(F.col("every_n"), 1, limits.step),
            "max_frames": limit,
            "quality": _within(F.col("quality"), 0, 100).cast("int"),
            "base_name": sanitize_base_name(F.col("base_name")),
            "target_times": F.slice(targets, F.lit(1), F.least(limit, F.lit(2**31 - 1)).cast("int")),
            "sheet": sheet,
        }
    ).select(*requests.columns)


def estimated_total(requests: DataFrame, media: DataFrame) -> DataFrame:
    """requests + ``estimated_total``: expected frames of a range export, 0 when not known."""
    m = media.select("media_id", F.col("duration_ns").alias("_d"), F.col("declared_frames").alias("_f"))
    big = "decimal(38,0)"
    span = F.greatest(F.col("range_end_ns") - F.col("range_start_ns"), F.lit(0))
    top = F.col("_f").cast(big) * F.least(span, F.col("_d")).cast("decimal(19,0)")
    bottom = F.col("_d").cast(big) * F.col("every_n").cast("decimal(7,0)")
    ceiling = F.call_function("div", top + bottom - 1, bottom)
    known = (F.col("_f") > 0) & (F.col("_d") > 0)
    total = F.when(known, F.least(ceiling, F.col("max_frames"))).otherwise(F.lit(0).cast("bigint"))
    return requests.join(m, "media_id", "left").withColumn("estimated_total", F.coalesce(total, F.lit(0))).drop("_d", "_f")
