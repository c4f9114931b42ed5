"""Plane metrics, comparison and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import search as V
from .base import PIXELS, dbl, query, with_


def planes(spark, folder):
    return A.planes_from_embeddings(A.load(spark, folder, "embeddings"))


PAIRED = PIXELS + """,
pp AS (SELECT a.media_id, a.idx, a.p, a.v, b.v AS w FROM px a LEFT JOIN px b ON b.media_id = a.media_id AND b.idx = a.idx - 1 AND b.p = a.p),
hist AS (SELECT media_id, idx, v // 8 AS bin, COUNT(*) AS c FROM px GROUP BY 1, 2, 3),
shared AS (
  SELECT a.media_id, a.idx, SUM(LEAST(a.c, b.c)) AS overlap FROM hist a
  JOIN hist b ON b.media_id = a.media_id AND b.idx = a.idx - 1 AND b.bin = a.bin GROUP BY 1, 2),
bits AS (
  SELECT media_id, idx, SUM(CASE WHEN p % 8 < 7 AND v >= nv THEN CAST(1 AS HUGEINT) << (p // 8 * 7 + p % 8) ELSE 0 END)
         + (CAST(SUM(v) // 64 AS HUGEINT) << 56) AS h
  FROM (SELECT *, LEAD(v) OVER (PARTITION BY media_id, idx ORDER BY p) AS nv FROM px) GROUP BY 1, 2),
phash AS (SELECT media_id, idx, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS ph FROM bits),
sc AS (
  SELECT m.media_id, m.idx, m.motion, m.scored, COALESCE(s.overlap, 0) / 64.0::DOUBLE AS hs,
         1 - bit_count(xor(h.ph, g.ph)) / 64.0::DOUBLE AS ps, h.ph
  FROM (SELECT media_id, idx, SUM(ABS(v - w)) / (255.0::DOUBLE * 64) AS motion, COUNT(w) > 0 AS scored FROM pp GROUP BY 1, 2) m
  LEFT JOIN shared s ON s.media_id = m.media_id AND s.idx = m.idx
  JOIN phash h ON h.media_id = m.media_id AND h.idx = m.idx
  LEFT JOIN phash g ON g.media_id = m.media_id AND g.idx = m.idx - 1)"""


@query(
    "frame_metrics",
    with_(PAIRED)
    + """SELECT media_id, idx AS presentation_index, ph AS perceptual_hash,
      ROUND(CAST(CAST(CASE WHEN scored THEN motion ELSE -1 END AS FLOAT) AS DOUBLE), 5) AS motion,
      ROUND(CAST(CAST(CASE WHEN scored THEN 0.8 * (1 - motion) + 0.2 * hs ELSE -1 END AS FLOAT) AS DOUBLE), 5) AS similarity,
      ROUND(CAST(CAST(CASE WHEN scored THEN 0.65 * motion + 0.35 * (1 - hs) ELSE -1 END AS FLOAT) AS DOUBLE), 5) AS scene_score,
      ROUND(CAST(CAST(CASE WHEN scored THEN 0.6 * (1 - motion) + 0.2 * hs + 0.2 * LEAST(1 - motion, ps) ELSE -1 END AS FLOAT) AS DOUBLE), 5) AS duplicate_score
    FROM sc""",
)
def frame_metrics(spark, folder):
    out = M.analyse_planes(planes(spark, folder))
    return out.select(
        "media_id", "presentation_index", "perceptual_hash",
        *[dbl(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), 5).alias(c)
          for c in ("motion", "similarity", "scene_score", "duplicate_score")],
    )


@query(
    "content_hash",
    with_(PIXELS, """
    bytes AS (SELECT media_id, idx, list(v ORDER BY p) AS vs FROM px GROUP BY 1, 2),
    fold AS (SELECT media_id, idx, list_reduce(
        list_concat([14695981039346656037::UHUGEINT], list_transform(list_concat(vs, [8, 8, 0, 0, 0, 0, 0, 0]), lambda v: v::UHUGEINT)),
        lambda h, v: xor(h, v) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM bytes)""")
    + """SELECT media_id, idx AS presentation_index,
      CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS content_hash FROM fold""",
)
def content_hash(spark, folder):
    return M.analyse_planes(planes(spark, folder)).select("media_id", "presentation_index", "content_hash")


@query(
    "valid_planes",
    with_(PIXELS) + "SELECT media_id, COUNT(DISTINCT idx) AS n, SUM(v) AS total FROM px WHERE idx % 3 <> 0 GROUP BY 1",
)
def valid_planes(spark, folder):
    """Every third plane lost its last byte and is not valid any more."""
    cut = F.when(F.col("presentation_index") % 3 == 0, F.substring("data", 1, 63)).otherwise(F.col("data"))
    good = M.valid_planes(planes(spark, folder).withColumn("data", cut))
    # Byte values of the surviving planes, summed without leaving the JVM.
    value = F.aggregate(
        F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("bigint"),
    )
    return good.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


@query(
    "luma_half_size",
    with_(PIXELS)
    + """SELECT media_id, idx AS presentation_index, SUM(q) AS total FROM (
      SELECT media_id, idx, CAST(floor(SUM(v) / 4.0::DOUBLE + 0.5) AS BIGINT) AS q FROM px GROUP BY 1, 2, p // 8 // 2, p % 8 // 2)
    GROUP BY 1, 2""",
)
def luma_half_size(spark, folder):
    small = M.luma_planes(planes(spark, folder), 4, 4)
    value = F.aggregate(
        F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("bigint"),
    )
    return small.select("media_id", "presentation_index", value.alias("total"))


def _pairs(frames):
    """Each frame with the next one of its media; the last has no partner."""
    return frames.select(
        F.concat_ws(":", "media_id", "presentation_index").alias("pair_id"),
        F.col("media_id").alias("a_media"), F.col("presentation_index").alias("a_index"),
        F.col("media_id").alias("b_media"), (F.col("presentation_index") + 1).alias("b_index"),
    )


def _paired(frames):
    return C.pair_planes(_pairs(frames.select("media_id", "presentation_index")), frames)


COLOR = PIXELS + """,
duo AS (
  SELECT a.media_id || ':' || a.idx AS pair_id, a.p, a.v, b.v AS w
  FROM px a JOIN px b ON b.media_id = a.media_id AND b.idx = a.idx + 1 AND b.p = a.p WHERE a.p < 63),
err AS (SELECT pair_id, SUM((v - w) * (v - w)) / 63.0::DOUBLE AS mse FROM duo GROUP BY 1),
lum AS (
  SELECT pair_id, p // 3 AS px,
    SUM(CASE p % 3 WHEN 0 THEN 0.2126::DOUBLE WHEN 1 THEN 0.7152::DOUBLE ELSE 0.0722::DOUBLE END * v) AS x,
    SUM(CASE p % 3 WHEN 0 THEN 0.2126::DOUBLE WHEN 1 THEN 0.7152::DOUBLE ELSE 0.0722::DOUBLE END * w) AS y
  FROM duo GROUP BY 1, 2),
mom AS (SELECT pair_id, AVG(x) AS mx, AVG(y) AS my, AVG(x * x) AS xx, AVG(y * y) AS yy, AVG(x * y) AS xy FROM lum GROUP BY 1),
blk AS (
  SELECT pair_id, GREATEST(LEAST((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225)
    / ((mx * mx + my * my + 6.5025) * (GREATEST(xx - mx * mx, 0) + GREATEST(yy - my * my, 0) + 58.5225)), 1), -1) AS ssim FROM mom)"""


@query(
    "pair_quality",
    with_(COLOR)
    + """SELECT f.media_id || ':' || f.idx AS pair_id, CASE WHEN mse IS NULL THEN 0 ELSE 1 END AS comparable,
      COALESCE(ROUND(mse, 4), -1) AS mse, COALESCE(ROUND(10 * log10(65025 / mse), 4), -1) AS psnr,
      COALESCE(ROUND(CASE WHEN ssim < 0 THEN 0 ELSE ssim END, 4), -1) AS ssim
    FROM vec f LEFT JOIN err ON err.pair_id = f.media_id || ':' || f.idx LEFT JOIN blk ON blk.pair_id = err.pair_id""",
)
def pair_quality(spark, folder):
    out = C.compare_pairs(_paired(A.color_planes_from_embeddings(A.load(spark, folder, "embeddings"))), "string")
    keep = lambda c: F.coalesce(F.round(c, 4), F.lit(-1.0)).alias(c)
    return out.select("pair_id", F.col("comparable").cast("bigint").alias("comparable"), keep("mse"), keep("psnr"), keep("ssim"))


@query(
    "ssim_map",
    with_(COLOR) + "SELECT pair_id, 0 AS block_y, 0 AS block_x, 21 AS pixels, ROUND(ssim, 4) AS ssim FROM blk",
)
def ssim_map(spark, folder):
    out = C.ssim_map(_paired(A.color_planes_from_embeddings(A.load(spark, folder, "embeddings"))), "string")
    ints = [F.col(c).cast("bigint").alias(c) for c in ("block_y", "block_x", "pixels")]
    return out.select("pair_id", *ints, F.round("ssim", 4).alias("ssim"))


@query(
    "equal_images",
    with_(PIXELS)
    + """SELECT a.media_id || ':' || a.idx AS pair_id,
      CASE WHEN MAX(ABS(CASE WHEN a.idx % 2 = 0 THEN a.v ELSE b.v END - a.v)) = 0 THEN 1 ELSE 0 END AS equal
    FROM px a JOIN px b ON b.media_id = a.media_id AND b.idx = a.idx + 1 AND b.p = a.p GROUP BY 1""",
)
def equal_images(spark, folder):
    """Even frames are paired with themselves, odd ones with the next."""
    frames = planes(spark, folder)
    pairs = _pairs(frames).join(
        frames.select(F.col("media_id").alias("b_media"), F.col("presentation_index").alias("b_index")), ["b_media", "b_index"]
    ).withColumn("b_index", F.when(F.col("a_index") % 2 == 0, F.col("a_index")).otherwise(F.col("b_index")))
    out = M.equal_images(C.pair_planes(pairs, frames))
    return out.select("pair_id", F.col("equal").cast("bigint").alias("equal"))


@query(
    "analyse_ranges",
    with_(PAIRED, "rg AS (SELECT media_id, MAX(idx) // 2 AS s, MAX(idx) * 3 // 4 AS e FROM vec GROUP BY 1)")
    + """SELECT media_id, idx AS presentation_index, ROUND(CAST(CAST(motion AS FLOAT) AS DOUBLE), 5) AS motion FROM sc JOIN rg USING (media_id)
    WHERE idx BETWEEN s AND e""",
)
def analyse_ranges(spark, folder):
    """Third quarter of every media, with one second of context read before it."""
    p = planes(spark, folder)
    frames = p.select(
        "media_id", "presentation_index", F.col("presentation_index").alias("pts"),
        (F.col("presentation_index") * 40_000_000).alias("pt_ns"),
        F.lit(40_000_000).cast("bigint").alias("duration_ns"), F.lit(False).alias("key_frame"),
    )
    last = p.groupBy("media_id").agg(F.max("presentation_index").alias("n"))
    part = lambda k: F.call_function("div", F.col("n") * k, F.lit(4)) * 40_000_000
    ranges = last.select("media_id", F.lit("third").alias("range_id"), part(2).alias("start_ns"), part(3).alias("end_ns"))
    out = M.analyse_ranges(p, frames, ranges)
    return out.select("media_id", "presentation_index", dbl("motion", 5).alias("motion"))


@query(
    "analyse_overlapping_ranges",
    with_(
        PAIRED,
        "rg AS (SELECT media_id, 'r' || k AS range_id, n * k // 20 AS s, n * 3 // 4 AS e FROM (SELECT media_id, MAX(idx) AS n FROM vec GROUP BY 1), range(10) t(k))",
    )
    + """SELECT media_id, range_id, idx AS presentation_index, h AS perceptual_hash,
      CASE WHEN idx > s THEN ROUND(CAST(CAST(motion AS FLOAT) AS DOUBLE), 5) END AS motion
    FROM (SELECT media_id, idx, motion, ph AS h FROM sc) JOIN rg USING (media_id) WHERE idx BETWEEN s AND e""",
)
def analyse_overlapping_ranges(spark, folder):
    """Ten ranges of every media that overlap each other, each without context before it."""
    p = planes(spark, folder)
    frames = p.select(
        "media_id", "presentation_index", F.col("presentation_index").alias("pts"),
        (F.col("presentation_index") * 40_000_000).alias("pt_ns"),
        F.lit(40_000_000).cast("bigint").alias("duration_ns"), F.lit(False).alias("key_frame"),
    )
    last = p.groupBy("media_id").agg(F.max("presentation_index").alias("n"))
    many = last.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    ranges = many.select(
        "media_id", F.concat(F.lit("r"), "k").alias("range_id"), (F.expr("n * k div 20") * 40_000_000).alias("start_ns"),
        (F.expr("n * 3 div 4") * 40_000_000).alias("end_ns"),
    )
    out = M.analyse_ranges(p, frames, ranges, 0)
    return out.select("media_id", "range_id", "presentation_index", "perceptual_hash", dbl("motion", 5).alias("motion"))


HASHES = """
vec AS (SELECT CAST(label AS VARCHAR) AS media_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
               vec_id, embedding FROM embeddings),
hs AS (
  SELECT media_id, vec_id, idx, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h
  FROM (SELECT media_id, vec_id, idx, SUM(CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END) AS h
        FROM (SELECT media_id, vec_id, idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vec)
        GROUP BY 1, 2, 3)),
hits AS (
  SELECT q.vec_id AS query_id, s.idx, bit_count(xor(q.h, s.h)) AS d,
         ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.h, s.h)), ABS(s.idx - q.idx), s.idx) AS rank
  FROM hs q JOIN hs s ON s.media_id = q.media_id AND s.idx <> q.idx WHERE bit_count(xor(q.h, s.h)) <= {radius})"""


def _search(spark, folder, distance, results=48):
    h = A.hashes_from_embeddings(A.load(spark, folder, "embeddings"))
    q = h.select(
        F.col("vec_id").alias("query_id"), "media_id", F.col("perceptual_hash").alias("q_hash"),
        F.col("pt_ns").alias("q_time"), F.col("presentation_index").alias("q_index"),
    )
    out = V.find_similar(q, h, results, distance)
    return out.select(
        "query_id", F.col("presentation_index").alias("frame"), F.col("hamming").cast("bigint").alias("hamming"),
        F.col("rank").cast("bigint").alias("rank"), dbl("similarity").alias("similarity"),
    )


SEARCH = "SELECT query_id, idx AS frame, d AS hamming, rank, ROUND(1 - d / 64.0::DOUBLE, 6) AS similarity FROM hits WHERE rank <= {n}"


@query("visual_search_topk", with_(HASHES.format(radius=24)) + SEARCH.format(n=48))
def visual_search(spark, folder):
    return _search(spark, folder, 24)


@query("visual_search_top3", with_(HASHES.format(radius=28)) + SEARCH.format(n=3))
def visual_search_top3(spark, folder):
    return _search(spark, folder, 28, 3)


@query(
    "visual_search_bands",
    with_(HASHES.format(radius=24).replace("hits AS", "unused AS"), """
    near AS (SELECT media_id, vec_id, idx, xor(h, CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 0 END) AS h FROM hs),
    every AS (SELECT media_id, idx * 2 AS idx, h FROM hs UNION ALL SELECT media_id, idx * 2 + 1, h FROM near),
    hits AS (
      SELECT q.vec_id AS query_id, s.idx, bit_count(xor(q.h, s.h)) AS d,
             ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.h, s.h)), ABS(s.idx - q.idx * 2), s.idx) AS rank
      FROM hs q JOIN every s ON s.media_id = q.media_id AND s.idx <> q.idx * 2 WHERE bit_count(xor(q.h, s.h)) <= 4)""")
    + SEARCH.format(n=48),
)
def visual_search_bands(spark, folder):
    """Every frame again with at most two bits changed, found by a small radius."""
    h = A.hashes_from_embeddings(A.load(spark, folder, "embeddings"))
    place = lambda df, k: df.withColumn("presentation_index", F.col("presentation_index") * 2 + k).withColumn(
        "pt_ns", F.col("presentation_index") * 40_000_000
    )
    changed = h.withColumn(
        "perceptual_hash", F.col("perceptual_hash").bitwiseXOR(F.when(F.col("vec_id") % 2 == 0, 5).otherwise(0).cast("bigint"))
    )
    first = place(h, 0)
    q = first.select(
        F.col("vec_id").alias("query_id"), "media_id", F.col("perceptual_hash").alias("q_hash"),
        F.col("pt_ns").alias("q_time"), F.col("presentation_index").alias("q_index"),
    )
    out = V.find_similar(q, first.unionByName(place(changed, 1)), 48, 4)
    return out.select(
        "query_id", F.col("presentation_index").alias("frame"), F.col("hamming").cast("bigint").alias("hamming"),
        F.col("rank").cast("bigint").alias("rank"), dbl("similarity").alias("similarity"),
    )
