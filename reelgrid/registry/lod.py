"""LOD and heatmap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..config import LodConfig
from ..functions.scores import combined_score, heatmap_average, heatmap_peak
from ..operators import lod as L
from ..session import materialise, scratch
from ..sources import tables as IO
from .base import EVENTS, GEOMETRY, LOD, combined_sql, dbl, query, samples, with_


def geometry(s):
    return L.lod_geometry(A.media_from_samples(s), LOD)


@query(
    "lod_base",
    with_(EVENTS, GEOMETRY)
    + """SELECT media_id, bucket, sample_count, ROUND(motion_sum, 6) AS motion_sum,
      ROUND(CAST(motion_min AS DOUBLE), 6) AS motion_min, ROUND(CAST(motion_max AS DOUBLE), 6) AS motion_max
    FROM acc WHERE level = 0""",
)
def lod_base(spark, folder):
    s = samples(spark, folder)
    return L.lod_base(s, geometry(s)).select(
        "media_id", "bucket", "sample_count", dbl("motion_sum").alias("motion_sum"),
        dbl("motion_min").alias("motion_min"), dbl("motion_max").alias("motion_max"),
    )


@query(
    "lod_levels",
    with_(EVENTS, GEOMETRY)
    + """SELECT media_id, level, bucket, sample_count,
      LEAST(bucket * span_ns * CAST(4 ** level AS BIGINT), duration_ns) AS start_ns,
      LEAST((bucket + 1) * span_ns * CAST(4 ** level AS BIGINT), duration_ns) AS end_ns,
      ROUND(motion_sum / sample_count, 5) AS motion_avg,
      ROUND(similarity_sum / sample_count, 5) AS similarity_avg,
      ROUND(scene_sum / sample_count, 5) AS scene_avg
    FROM acc""",
)
def lod_levels(spark, folder):
    s = samples(spark, folder)
    out = L.build_lod(s, geometry(s), LOD)
    return out.select(
        "media_id", F.col("level").cast("bigint").alias("level"), "bucket", "sample_count", "start_ns", "end_ns",
        *[F.round(F.col(f"{x}_sum") / F.col(f"{x}_count"), 5).alias(f"{x}_avg") for x in L.SCORES],
    )


@query("stored_lod", with_(EVENTS, GEOMETRY) + "SELECT media_id, level, bucket, sample_count + CASE WHEN level = 1 THEN 1000 ELSE 0 END AS sample_count FROM acc")
def stored_lod(spark, folder):
    """All levels stored, the second replaced, and then a version of wrong rows that was not published."""
    s = samples(spark, folder)
    rows = L.build_lod(s, geometry(s), LOD).select("media_id", "level", "bucket", "sample_count")
    path = scratch(spark, "lod")
    IO.write_results(rows, path, by=("level",), order=("bucket",), whole=True)
    more = IO.read_results(spark, path).where("level = 1").withColumn("sample_count", F.col("sample_count") + 1000)
    IO.write_results(more, path, by=("level",), order=("bucket",))
    IO.write_results(rows.withColumn("sample_count", F.lit(-1).cast("bigint")), path, by=("level",), order=("bucket",), publish=False)
    return IO.read_results(spark, path).select("media_id", F.col("level").cast("bigint").alias("level"), "bucket", "sample_count")


DEEP = GEOMETRY.replace("LEAST(n, 64) AS t", "60000 AS t").replace("generate_series(0, 4)", "generate_series(0, 8)")


@query(
    "lod_deep",
    with_(EVENTS, DEEP)
    + """SELECT media_id, level, bucket, sample_count, ROUND(motion_sum, 6) AS motion_sum, ROUND(CAST(motion_min AS DOUBLE), 6) AS motion_min,
      ROUND(CAST(scene_max AS DOUBLE), 6) AS scene_max FROM acc""",
)
def lod_deep(spark, folder):
    """60,000 base buckets: nine levels, over blocks of 4,096 buckets."""
    s = samples(spark, folder)
    config = LodConfig(base_buckets=65_536)
    g = L.lod_geometry(A.media_from_samples(s).withColumn("estimated", F.lit(60_000).cast("bigint")), config)
    return L.build_lod(s, g, config).select(
        "media_id", F.col("level").cast("bigint").alias("level"), "bucket", "sample_count", dbl("motion_sum").alias("motion_sum"),
        dbl("motion_min").alias("motion_min"), dbl("scene_max").alias("scene_max"),
    )


VIEW = GEOMETRY + """,
req AS (SELECT media_id, duration_ns // 4 AS s, duration_ns * 3 // 4 AS e, span_ns, buckets, duration_ns FROM geometry),
lv AS (
  SELECT *, CAST(4 ** k AS BIGINT) AS w,
    (LEAST(s // span_ns, buckets - 1)) // CAST(4 ** k AS BIGINT) AS f,
    (CASE WHEN e >= duration_ns THEN buckets - 1 ELSE LEAST(e // span_ns, buckets - 1) END) // CAST(4 ** k AS BIGINT) AS l
  FROM req, generate_series(0, 4) AS x(k) WHERE k = 0 OR buckets > CAST(4 ** (k - 1) AS BIGINT)),
pick AS (SELECT media_id, COALESCE(MIN(CASE WHEN l - f + 1 <= 8 THEN k END), MAX(k)) AS level FROM lv GROUP BY 1),
view AS (
  SELECT a.*, p.level AS lvl FROM pick p JOIN lv ON lv.media_id = p.media_id AND lv.k = p.level
  JOIN acc a ON a.media_id = p.media_id AND a.level = p.level AND a.bucket BETWEEN lv.f AND lv.l)"""


def _view(spark, folder):
    s = samples(spark, folder)
    g = geometry(s)
    requests = g.select(
        "media_id",
        F.lit("middle").alias("request_id"),
        F.call_function("div", F.col("duration_ns"), F.lit(4)).alias("start_ns"),
        F.call_function("div", F.col("duration_ns") * 3, F.lit(4)).alias("end_ns"),
        F.lit(8).alias("budget"),
    )
    return L.lod_view(L.build_lod(s, g, LOD), requests, g, LOD)


@query(
    "lod_view_combined",
    with_(EVENTS, VIEW)
    + """SELECT media_id, lvl AS level, bucket, sample_count,
      ROUND({}, 4) AS combined
    FROM view""".format(combined_sql("motion_sum / sample_count", "(CAST(1 AS FLOAT) - CAST(similarity_sum / sample_count AS FLOAT))", "scene_sum / sample_count")),
)
def lod_view_combined(spark, folder):
    v = _view(spark, folder)
    score = heatmap_average("combined", {c: F.col(c) for c in v.columns})
    return v.select(
        "media_id", F.col("level").cast("bigint").alias("level"), "bucket", "sample_count", dbl(score, 4).alias("combined")
    )


@query(
    "heatmap_average",
    with_(EVENTS, VIEW)
    + """SELECT media_id, bucket, m AS mode, ROUND(CAST(CAST(CASE m WHEN 'motion' THEN motion_sum WHEN 'similarity' THEN similarity_sum
        ELSE scene_sum END / sample_count AS FLOAT) AS DOUBLE), 5) AS score
    FROM view, (VALUES ('motion'), ('similarity'), ('scene')) AS t(m)""",
)
def heatmap_average_(spark, folder):
    v = _view(spark, folder).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in L.SCORES])))
    score = heatmap_average(F.col("mode"), {c: F.col(c) for c in v.columns})
    return v.select("media_id", "bucket", "mode", dbl(score, 5).alias("score"))


@query(
    "heatmap_peak",
    with_(EVENTS, VIEW)
    + """SELECT media_id, bucket, ROUND(CAST(motion_max AS DOUBLE), 5) AS motion_peak,
      ROUND({}, 4) AS combined_peak
    FROM view""".format(combined_sql("motion_max", "(CAST(1 AS FLOAT) - similarity_min)", "scene_max")),
)
def heatmap_peak_(spark, folder):
    v = _view(spark, folder)
    b = {c: F.col(c) for c in v.columns}
    return v.select(
        "media_id", "bucket", dbl(heatmap_peak("motion", b), 5).alias("motion_peak"),
        dbl(heatmap_peak("combined", b), 4).alias("combined_peak"),
    )


@query(
    "combined_score",
    with_(EVENTS)
    + """SELECT media_id, presentation_index,
      ROUND({}, 4) AS score
    FROM samples""".format(combined_sql("motion", "(CAST(1 AS FLOAT) - similarity)", "duplicate_score")),
)
def combined(spark, folder):
    one = F.lit(1.0).cast("float")
    return samples(spark, folder).df.select(
        "media_id", "presentation_index",
        dbl(combined_score(F.col("motion"), one - F.col("similarity"), F.col("duplicate_score")), 4).alias("score"),
    )


@query(
    "lod_replace_range",
    with_(EVENTS, GEOMETRY)
    + """SELECT media_id, level, bucket, sample_count, ROUND(motion_sum, 6) AS motion_sum,
      ROUND(similarity_sum, 6) AS similarity_sum FROM acc""",
)
def lod_replace_range(spark, folder):
    """Halved motion in the second third of each media, then put right by a range replacement."""
    s = samples(spark, folder)
    s = s.to(materialise(s.df))
    g = materialise(geometry(s))
    third = F.call_function("div", F.col("duration_ns"), F.lit(3))
    changed = g.select("media_id", third.alias("start_ns"), (third * 2).alias("end_ns"))
    aligned = g.select(
        "media_id", *[c.alias(n) for c, n in zip(
            L.aligned_range(third, third * 2, {k: F.col(k) for k in ("duration_ns", "span_ns", "buckets")}), ("lo", "hi"))]
    )
    inside = F.col("pt_ns").between(F.col("lo"), F.col("hi"))
    stale = s.plain().join(aligned, "media_id").withColumn(
        "motion", F.when(inside & F.col("pt_ns").between(F.col("lo"), F.col("hi") - 1), F.col("motion") / 2).otherwise(F.col("motion")).cast("float")
    )
    old = L.lod_levels(L.lod_base(stale, g), LOD)
    out = L.replace_range(old, changed, s.plain(), g, LOD)
    return out.select(
        "media_id", F.col("level").cast("bigint").alias("level"), "bucket", "sample_count",
        dbl("motion_sum").alias("motion_sum"), dbl("similarity_sum").alias("similarity_sum"),
    )


@query(
    "coverage",
    with_(EVENTS)
    + """SELECT m.media_id, COUNT(s.pt_ns) AS sample_count,
      ROUND(CASE WHEN m.media_id < '5' THEN LEAST(COUNT(s.pt_ns) / CAST(n AS DOUBLE), 1)
        ELSE LEAST(COALESCE(MAX_BY(s.pt_ns + s.duration_ns, s.presentation_index), 0) / CAST(m.duration_ns AS DOUBLE), 1) END, 6) AS coverage
    FROM media m LEFT JOIN samples s ON s.media_id = m.media_id AND s.event_type <> 'click'
    WHERE m.duration_ns > 0 GROUP BY m.media_id, n, m.duration_ns""",
)
def coverage(spark, folder):
    """Share analysed when clicks are missing; declared counts are known for some media only."""
    s = samples(spark, folder)
    media = A.media_from_samples(s).where("duration_ns > 0").withColumn(
        "declared_frames", F.when(F.col("media_id") < "5", F.col("declared_frames")).otherwise(F.lit(0))
    )
    out = L.coverage(s.df.where("event_type <> 'click'"), media)
    return out.select("media_id", "sample_count", dbl("coverage").alias("coverage"))


@query(
    "estimated_samples",
    with_(EVENTS)
    + """SELECT media_id, estimated, LEAST(estimated, 2000000) AS at_most FROM (
      SELECT media_id, CASE WHEN n % 3 = 0 THEN n
        WHEN n % 3 = 1 THEN duration_ns // 41708333 + 1 ELSE duration_ns // 33333333 + 1 END AS estimated
      FROM media WHERE duration_ns > 0)""",
)
def estimated(spark, folder):
    m = A.media_from_samples(samples(spark, folder)).where("duration_ns > 0")
    rate = lambda on: F.struct(F.when(on, 24000).otherwise(0).alias("num"), F.lit(1001).alias("den"))
    kind = F.col("declared_frames") % 3
    m = m.withColumns({"avg_rate": rate(F.lit(False)), "real_rate": rate(kind == 1)}).withColumn(
        "declared_frames", F.when(kind == 0, F.col("declared_frames")).otherwise(0)
    )
    free = L.estimated_samples(m).select("media_id", "estimated")
    capped = L.estimated_samples(m, maximum=2_000_000).select("media_id", F.col("estimated").alias("at_most"))
    return free.join(capped, "media_id")
