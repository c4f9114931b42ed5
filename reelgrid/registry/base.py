"""Shared inputs of the registered queries and the SQL that describes the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..config import SECOND, DetectionConfig, LodConfig
from ..operators.order import Ordered, chunk_rows, small_groups

HOUR = 3600 * SECOND

# Events are hours apart, so the time thresholds are wide and the frame counts small.
DETECT = DetectionConfig(
    scene_separation_ns=12 * HOUR, freeze_duration_ns=0, freeze_frames=3, repeated_frames=2, perceptual_distance=0
)
LOD = LodConfig(base_buckets=64)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        CATALOGUE[name] = Query(run, sql)
        return run

    return add


def samples(spark: SparkSession, folder: str) -> Ordered:
    return A.samples_from_events(A.load(spark, folder, "events"))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    return A.probes_from_orders(A.load(spark, folder, "orders"), A.media_count(A.load(spark, folder, "events")))


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    return A.ranges_from_lineitem(A.load(spark, folder, "lineitem"), A.media_count(A.load(spark, folder, "events")))


def few_ranges(spark: SparkSession, folder: str, each: int) -> bool | None:
    """True where no media has more line items, ``each`` times, than a chunk has rows; a range is one or more of them."""
    items = A.load(spark, folder, "lineitem").select((F.col("l_orderkey") % A.media_count(A.load(spark, folder, "events"))).alias("media_id"))
    return small_groups(items, rows_per_chunk=max(1, chunk_rows(items) // each)) or None


def known(c: Column | str) -> Column:
    """BIGINT with -1 for null, so that both engines hash the same value."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-1)).cast("bigint")


def dbl(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def cast(df: DataFrame, **columns) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in columns.items()])


EVENTS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS media_id, event_id, epoch_us(ts) AS us, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events),
eo AS (
  SELECT *, ROW_NUMBER() OVER w - 1 AS idx, MIN(us) OVER (PARTITION BY media_id) AS us0,
         LEAD(us) OVER w AS us1, LEAST(value / 500, 1.0) AS lv
  FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY us, event_id)),
samples AS (
  SELECT media_id, idx AS presentation_index, event_id AS pts, (us - us0) * 1000 AS pt_ns,
         COALESCE(us1 - us, 0) * 1000 AS duration_ns, event_type = 'signup' AS key_frame,
         CAST(lv AS FLOAT) AS motion, CAST(1 - lv / 2 AS FLOAT) AS similarity,
         CAST(lv AS FLOAT) AS scene_score,
         CASE WHEN idx > 0 THEN CAST(GREATEST(0.0, 1 - lv) AS FLOAT) END AS duplicate_score,
         CAST(floor(value) AS BIGINT) AS content_hash, k // 25 AS perceptual_hash, event_type
  FROM eo),
media AS (
  SELECT media_id, MAX(pt_ns) AS duration_ns, COUNT(*) AS n FROM samples GROUP BY media_id)"""

PROBES = """
probes AS (
  SELECT CAST(o_custkey % (SELECT MAX(user_id) + 1 FROM events) AS VARCHAR) AS media_id, o_orderkey AS probe_id,
         CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000000000 AS target_ns,
         o_orderkey % 97 AS index_hint, o_orderkey % 7 * 7200000000000 AS tolerance_ns
  FROM orders)"""

RANGES = """
ranges AS (
  SELECT media_id, s AS start_ns, e AS end_ns, media_id || ':' || s || ':' || e AS range_id FROM (
    SELECT DISTINCT CAST(l_orderkey % (SELECT MAX(user_id) + 1 FROM events) AS VARCHAR) AS media_id, d AS s,
           d + CAST(l_quantity AS BIGINT) * 1800000000000 AS e
    FROM (SELECT *, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000000000000 AS d
          FROM lineitem)))"""

# Frames around each distinct probe time. With ties: before takes the last, after the first.
BRACKET = """
targets AS (SELECT DISTINCT media_id, target_ns FROM probes),
bef AS (
  SELECT t.media_id, t.target_ns, MAX(s.presentation_index) AS b
  FROM targets t JOIN samples s ON s.media_id = t.media_id AND s.pt_ns <= t.target_ns GROUP BY 1, 2),
aft AS (
  SELECT t.media_id, t.target_ns, MIN(s.presentation_index) AS a
  FROM targets t JOIN samples s ON s.media_id = t.media_id AND s.pt_ns >= t.target_ns GROUP BY 1, 2),
around AS (
  SELECT t.media_id, t.target_ns, b, a, sb.pt_ns AS tb, sa.pt_ns AS ta
  FROM targets t LEFT JOIN bef USING (media_id, target_ns) LEFT JOIN aft USING (media_id, target_ns)
  LEFT JOIN samples sb ON sb.media_id = t.media_id AND sb.presentation_index = b
  LEFT JOIN samples sa ON sa.media_id = t.media_id AND sa.presentation_index = a),
near AS (
  SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR ta = target_ns THEN a
                 WHEN target_ns - tb <= ta - target_ns THEN b ELSE a END AS i FROM around)"""

GEOMETRY = """
g1 AS (SELECT media_id, duration_ns, LEAST(n, 64) AS t FROM media WHERE duration_ns > 0),
g2 AS (SELECT media_id, duration_ns, (duration_ns + t - 1) // t AS span_ns FROM g1),
geometry AS (SELECT *, (duration_ns + span_ns - 1) // span_ns AS buckets FROM g2),
base AS (
  SELECT s.media_id, CASE WHEN pt_ns >= geometry.duration_ns THEN buckets - 1 ELSE LEAST(pt_ns // span_ns, buckets - 1) END AS bucket,
         motion, similarity, scene_score, geometry.duration_ns, span_ns, buckets
  FROM samples s JOIN geometry USING (media_id)),
acc AS (
  SELECT media_id, k AS level, bucket // CAST(4 ** k AS BIGINT) AS bucket, COUNT(*) AS sample_count,
         SUM(CAST(motion AS DOUBLE)) AS motion_sum, MIN(motion) AS motion_min, MAX(motion) AS motion_max,
         SUM(CAST(similarity AS DOUBLE)) AS similarity_sum, MIN(similarity) AS similarity_min,
         SUM(CAST(scene_score AS DOUBLE)) AS scene_sum, MAX(scene_score) AS scene_max,
         ANY_VALUE(duration_ns) AS duration_ns, ANY_VALUE(span_ns) AS span_ns
  FROM base, generate_series(0, 4) AS l(k)
  WHERE k = 0 OR buckets > CAST(4 ** (k - 1) AS BIGINT)
  GROUP BY 1, 2, 3)"""

PIXELS = """
vec AS (SELECT CAST(label AS VARCHAR) AS media_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
               vec_id, embedding FROM embeddings),
px AS (
  SELECT media_id, idx, i - 1 AS p,
         CAST(floor(GREATEST(LEAST((CAST(x AS DOUBLE) + 0.6) / 1.2, 1.0), 0.0) * 255) AS BIGINT) AS v
  FROM (SELECT media_id, idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vec))"""


def combined_sql(motion: str, difference: str, scene: str) -> str:
    """Weighted mean in single precision, step by step; the motion is always there."""
    f = lambda x: f"CAST({x} AS FLOAT)"
    total = f"{f(0.5)} * {f(motion)} + {f(0.3)} * {f(difference)}"
    full = f"({total} + {f(0.2)} * {f(scene)}) / ({f(0.5)} + {f(0.3)} + {f(0.2)})"
    return f"CAST(CASE WHEN {scene} IS NULL THEN ({total}) / ({f(0.5)} + {f(0.3)}) ELSE {full} END AS DOUBLE)"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
