"""Sample identity, upserts and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import valid_score

SCORES = ("motion", "similarity", "scene_score", "duplicate_score")


def _latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``: a max aggregate, so it combines before the shuffle."""
    body = [c for c in rows.columns if c not in keys]
    pick = F.max_by(F.struct(*body), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*rows.columns)


def _indexed() -> Column:
    return F.coalesce(F.col("presentation_index") >= 0, F.lit(False))


def latest_by_identity(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Last row per identity: by index where known; rows without one by (time, pts), and only
    where no indexed row has that (time, pts)."""
    known = _latest(rows.where(_indexed()), ["media_id", "presentation_index"], order)
    bare = rows.where(~_indexed()).withColumn("presentation_index", F.lit(None).cast("bigint"))
    loose = _latest(bare, ["media_id", "pt_ns", "pts"], order)
    taken = known.select("media_id", F.col("pt_ns").alias("_t"), F.col("pts").alias("_p"))
    same = (
        (loose["media_id"] == taken["media_id"])
        & (loose["pt_ns"] == taken["_t"])
        & loose["pts"].eqNullSafe(taken["_p"])
    )
    return known.unionByName(loose.join(taken, same, "left_anti"))


def upsert_samples(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored samples with the incoming ones merged in; the highest ``ingest_seq`` wins per
    identity and the row moves to its new time."""
    rows = stored.unionByName(incoming)
    return latest_by_identity(rows, [F.col("ingest_seq"), F.col("pt_ns"), F.col("pts")])


def replace_samples(rows: DataFrame) -> DataFrame:
    """Bulk replacement: the first row in presentation order per identity is kept."""
    order = [-F.col("pt_ns"), -F.coalesce("presentation_index", F.lit(-1)), -F.coalesce("pts", F.lit(-(2**62)))]
    return latest_by_identity(rows, order)


def valid_sample() -> Column:
    ok = (F.col("pt_ns") >= 0) & (F.col("duration_ns") >= 0)
    for score in SCORES:
        ok = ok & valid_score(F.col(score))
    return F.coalesce(ok, F.lit(False))


def split_valid(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): one bad row rejects every row of its media."""
    bad = samples.where(~valid_sample()).select("media_id").distinct()
    return samples.join(bad, "media_id", "left_anti"), samples.join(bad, "media_id", "left_semi")


def upsert_boundaries(stored: DataFrame, incoming: DataFrame, media: DataFrame) -> DataFrame:
    """Frame boundaries merged by index, or by (pts, serial) when unindexed; rows outside
    [0, duration] or with a negative duration are not taken."""
    durations = media.select("media_id", F.col("duration_ns").alias("_d"))
    fresh = (
        incoming.join(durations, "media_id")
        .where((F.col("_d") > 0) & F.col("pt_ns").between(0, F.col("_d")) & (F.col("duration_ns") >= 0))
        .drop("_d")
    )
    rows = stored.unionByName(fresh)
    order = [F.col("ingest_seq"), F.col("pt_ns")]
    known = _latest(rows.where(_indexed()), ["media_id", "presentation_index"], order)
    loose = _latest(rows.where(~_indexed()), ["media_id", "presentation_index", "pts", "serial"], order)
    return known.unionByName(loose)
