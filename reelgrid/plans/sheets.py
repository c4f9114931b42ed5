"""Overview sheets as tables of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spacing import div, evenly_spaced
from ..functions.timebase import format_timestamp
from ..operators import lookups
from ..operators.asof import asof
from ..operators.order import Ordered
from .selection import BODY, drop_repeats, subsample


def sheet_targets(requests: DataFrame) -> DataFrame:
    """requests + ``targets``: spread over the range, or picked from the given target times."""
    wanted = F.col("sheet.frame_count")
    spread = evenly_spaced(F.col("range_start_ns"), F.col("range_end_ns"), wanted)
    none = F.coalesce(F.size("target_times") <= 0, F.lit(True))
    return requests.withColumn("targets", F.when(none, spread).otherwise(subsample(F.col("target_times"), wanted)))


def overview_sheet(requests: DataFrame, frames: DataFrame | Ordered, few: bool | None = None) -> DataFrame:
    """Cells of each request: frame, row, column and label, in order, repeats left out.

    Requests are normalised ones with a ``sheet``; a sheet has at most 1,024 cells.
    ``few`` tells that no media has many cells where the caller has counted them.
    """
    r = sheet_targets(requests).select("request_id", "media_id", "sheet", F.array_distinct("targets").alias("_targets"))
    if lookups.even(r, frames, "_targets", few):
        kept = lookups.nearest_frames(r, frames, BODY, "_targets", repeats=False)
        cell = F.col("ordinal")
    else:
        targets = r.select("request_id", "media_id", "sheet", F.explode("_targets").alias("target_ns"))
        hits = asof(targets, frames, BODY, "nearest")
        kept = drop_repeats(hits, ["request_id", "media_id", "sheet"])
        w = Window.partitionBy("request_id", "media_id").orderBy("target_ns")
        cell = (F.row_number().over(w) - 1).cast("bigint")
    h = F.col("hit")
    index = F.when(h["presentation_index"] >= 0, F.concat(F.lit("Frame "), h["presentation_index"])).otherwise(F.lit("Frame ?"))
    label = F.concat_ws(
        "  |  ",
        F.when(F.col("sheet.with_time"), format_timestamp(h["pt_ns"])),
        F.when(F.col("sheet.with_index"), F.coalesce(index, F.lit("Frame ?"))),
    )
    return (
        kept.withColumn("cell", cell)
        .withColumns(
            {
                "row": div(F.col("cell"), F.col("sheet.columns")),
                "column": F.col("cell") % F.col("sheet.columns"),
                "label": label,
            }
        )
        .where(F.col("row") < F.col("sheet.rows"))
        .select("request_id", "media_id", "cell", "row", "column", "label", "target_ns", *[h[c].alias(c) for c in BODY])
    )
