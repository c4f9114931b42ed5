"""Export manifest: one row per file a request would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import frame_file_name


def manifest(plan: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Plan rows (request_id, media_id, seq, frame columns) with their file names; without ``requests`` the plan
    has their base_name and format."""
    name = frame_file_name(
        F.col("base_name"), F.col("seq"), F.col("presentation_index"), F.col("pt_ns"), F.col("format")
    )
    if requests is not None:
        plan = plan.join(requests.select("request_id", "media_id", "base_name", "format"), ["request_id", "media_id"])
    return plan.withColumn("file_name", name).drop("base_name", "format")


def manifest_summary(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files per request, whether the limit was reached, and a code: ``frame_limit`` or ``no_frames``."""
    limit = F.col("limit_reached") if "limit_reached" in files.columns else F.lit(False)
    counts = files.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("files"), F.max(F.when(limit, 1).otherwise(0)).alias("_limit")
    )
    return requests.select("request_id", "media_id", "max_frames").join(counts, "request_id", "left").select(
        "request_id",
        "media_id",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce(F.col("_limit") == 1, F.lit(False)).alias("limit_reached"),
        F.when(F.col("_limit") == 1, F.lit("frame_limit"))
        .when(F.coalesce("files", F.lit(0)) == 0, F.lit("no_frames"))
        .alias("detail"),
    )
