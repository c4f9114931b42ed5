"""The named functions, called from SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.sql import register
from ..operators import lod as L
from .base import CATALOGUE, EVENTS, GEOMETRY, LOD, dbl, query, samples, with_


@query("sql_frame_metrics", CATALOGUE["frame_metrics"].sql)
def sql_frame_metrics(spark, folder):
    """Hashes and scores of all planes by one SQL statement."""
    register(spark)
    planes = A.planes_from_embeddings(A.load(spark, folder, "embeddings"))
    out = spark.sql(
        """SELECT media_id, presentation_index, perceptual_hash(data, width, height) AS perceptual_hash, frame_scores(data, previous, width, height) AS s
        FROM (SELECT *, lag(data) OVER (PARTITION BY media_id ORDER BY presentation_index) AS previous FROM {planes})""",
        planes=planes,
    )
    scores = [dbl(F.coalesce(F.col(f"s.{c}").cast("double"), F.lit(-1.0)), 5).alias(c) for c in ("motion", "similarity", "scene_score", "duplicate_score")]
    return out.select("media_id", "presentation_index", "perceptual_hash", *scores)


@query("sql_content_hash", CATALOGUE["content_hash"].sql)
def sql_content_hash(spark, folder):
    register(spark)
    planes = A.planes_from_embeddings(A.load(spark, folder, "embeddings"))
    return spark.sql("SELECT media_id, presentation_index, content_hash(data, width, height) AS content_hash FROM {planes}", planes=planes)


@query(
    "sql_pair_quality",
    """WITH v AS (SELECT CAST(label AS VARCHAR) AS media_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
    px AS (SELECT media_id, idx, i, floor(GREATEST(LEAST((CAST(x AS DOUBLE) + 0.6) / 1.2, 1.0), 0.0) * 255) AS v
      FROM (SELECT media_id, idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v)),
    st AS (SELECT a.media_id, a.idx, AVG((a.v - b.v) * (a.v - b.v)) AS mse, AVG(a.v) AS ma, AVG(b.v) AS mb,
      GREATEST(AVG(a.v * a.v) - AVG(a.v) * AVG(a.v), 0) AS va, GREATEST(AVG(b.v * b.v) - AVG(b.v) * AVG(b.v), 0) AS vb, AVG(a.v * b.v) - AVG(a.v) * AVG(b.v) AS cov
      FROM px a JOIN px b ON b.media_id = a.media_id AND b.idx = a.idx - 1 AND b.i = a.i GROUP BY 1, 2)
    SELECT media_id, idx AS presentation_index, ROUND(mse, 4) AS mse,
      ROUND(LEAST(GREATEST((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 0), 1), 4) AS ssim FROM st""",
)
def sql_pair_quality(spark, folder):
    """Every 8x8 plane, all 64 values of it, compared with the one before."""
    register(spark)
    planes = A.planes_from_embeddings(A.load(spark, folder, "embeddings"))
    return spark.sql(
        """SELECT media_id, presentation_index, round(plane_mse(data, previous, width, height, channels), 4) AS mse,
          round(plane_ssim(data, previous, width, height, channels), 4) AS ssim
        FROM (SELECT *, lag(data) OVER (PARTITION BY media_id ORDER BY presentation_index) AS previous FROM {planes}) WHERE previous IS NOT NULL""",
        planes=planes,
    )


@query("sql_evenly_spaced", CATALOGUE["evenly_spaced"].sql)
def sql_evenly_spaced(spark, folder):
    register(spark)
    orders = A.load(spark, folder, "orders")
    return spark.sql(
        "SELECT o_orderkey, position, value FROM {orders}, LATERAL evenly_spaced(0L, o_custkey, 1 + o_orderkey % 6)", orders=orders
    )


@query("sql_lod_levels", with_(EVENTS, GEOMETRY) + "SELECT media_id, level, COUNT(*) AS used FROM acc GROUP BY 1, 2")
def sql_lod_levels(spark, folder):
    """Levels from the table function, with the number of their buckets that hold samples."""
    register(spark)
    s = samples(spark, folder)
    g = L.lod_geometry(A.media_from_samples(s), LOD)
    return spark.sql(
        """SELECT l.media_id, CAST(l.level AS BIGINT) AS level, count(DISTINCT least(s.pt_ns, l.duration_ns - 1) DIV (l.span_ns * CAST(power(4, l.level) AS BIGINT))) AS used
        FROM (SELECT media_id, duration_ns, span_ns, level FROM {g}, LATERAL lod_levels(duration_ns, span_ns, 4)) l JOIN {s} s ON s.media_id = l.media_id
        GROUP BY l.media_id, l.level""",
        g=g, s=s.plain().select("media_id", "pt_ns"),
    )
