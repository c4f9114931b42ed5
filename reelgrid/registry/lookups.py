"""As-of, step, range and marker queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as S
from ..operators import ranges as R
from ..operators import steps as T
from .base import BRACKET, EVENTS, PROBES, RANGES, dbl, known, probes, query, ranges, samples, with_

ASOF = with_(EVENTS, PROBES, BRACKET)


def _asof(name: str, bias: str, column: str):
    @query(
        name,
        ASOF + f"SELECT p.probe_id, COALESCE({column}, -1) AS frame FROM probes p LEFT JOIN near USING (media_id, target_ns)",
    )
    def run(spark, folder):
        hit = S.asof(probes(spark, folder), samples(spark, folder), [], bias)
        return hit.select("probe_id", known("hit.presentation_index").alias("frame"))


_asof("asof_before", "at_or_before", "b")
_asof("asof_after", "at_or_after", "COALESCE(a, b)")
_asof("asof_nearest", "nearest", "i")


@query(
    "nearest_tolerance",
    ASOF
    + """SELECT p.probe_id, COALESCE(CASE
        WHEN ABS(ns.pt_ns - p.target_ns) <= p.tolerance_ns AND n.i = p.index_hint THEN n.i
        WHEN h.presentation_index IS NOT NULL THEN h.presentation_index
        WHEN ABS(ns.pt_ns - p.target_ns) <= p.tolerance_ns THEN n.i END, -1) AS frame
    FROM probes p LEFT JOIN near n USING (media_id, target_ns)
    LEFT JOIN samples ns ON ns.media_id = p.media_id AND ns.presentation_index = n.i
    LEFT JOIN samples h ON h.media_id = p.media_id AND h.presentation_index = p.index_hint""",
)
def nearest_tolerance(spark, folder):
    hit = S.nearest_sample(probes(spark, folder), samples(spark, folder), [])
    return hit.select("probe_id", known("hit.presentation_index").alias("frame"))


@query(
    "frame_hints",
    ASOF
    + """SELECT p.probe_id, COALESCE(i, -1) AS index_hint,
      CASE WHEN ns.pt_ns = p.target_ns THEN CASE WHEN ns.key_frame THEN 1 ELSE 0 END ELSE -1 END AS key_hint
    FROM probes p LEFT JOIN near n USING (media_id, target_ns)
    LEFT JOIN samples ns ON ns.media_id = p.media_id AND ns.presentation_index = n.i""",
)
def frame_hints(spark, folder):
    out = S.known_frame_hint(probes(spark, folder).drop("index_hint"), samples(spark, folder))
    return out.select("probe_id", known("index_hint").alias("index_hint"), known(F.col("key_hint").cast("int")).alias("key_hint"))


@query(
    "frame_scores",
    with_(EVENTS)
    + """SELECT media_id, presentation_index, ROUND(CAST(motion AS DOUBLE), 6) AS motion FROM samples""",
)
def frame_scores(spark, folder):
    s = samples(spark, folder)
    frames = s.plain().select("media_id", "presentation_index", "pts", "pt_ns")
    return S.attach_scores(frames, s, ["motion"]).select("media_id", "presentation_index", dbl("motion").alias("motion"))


@query(
    "frame_neighbours",
    with_(EVENTS)
    + """SELECT media_id, presentation_index, COALESCE(LAG(presentation_index) OVER w, -1) AS previous,
      COALESCE(LEAD(presentation_index) OVER w, -1) AS following
    FROM samples WINDOW w AS (PARTITION BY media_id ORDER BY pt_ns, presentation_index)""",
)
def frame_neighbours(spark, folder):
    out = T.frame_neighbours(samples(spark, folder))
    return out.select(
        "media_id", "presentation_index", known("previous.presentation_index").alias("previous"),
        known("following.presentation_index").alias("following"),
    )


@query(
    "keyframe_neighbours",
    with_(EVENTS)
    + """SELECT s.media_id, s.presentation_index,
      COALESCE(MAX(CASE WHEN k.presentation_index < s.presentation_index THEN k.presentation_index END), -1) AS previous_key,
      COALESCE(MIN(CASE WHEN k.presentation_index > s.presentation_index THEN k.presentation_index END), -1) AS next_key
    FROM samples s LEFT JOIN samples k ON k.media_id = s.media_id AND k.key_frame GROUP BY 1, 2""",
)
def keyframe_neighbours(spark, folder):
    out = T.keyframe_neighbours(samples(spark, folder))
    return out.select(
        "media_id", "presentation_index", known("previous_key.presentation_index").alias("previous_key"),
        known("next_key.presentation_index").alias("next_key"),
    )


@query(
    "frame_step",
    with_(EVENTS, PROBES)
    + """SELECT probe_id, COALESCE(CASE WHEN goal <> s.presentation_index THEN goal END, -1) AS frame FROM (
      SELECT p.probe_id, p.media_id, s.presentation_index, m.n,
        GREATEST(LEAST(s.presentation_index + p.probe_id % 41 - 20, m.n - 1), 0) AS goal
      FROM probes p LEFT JOIN samples s ON s.media_id = p.media_id AND s.presentation_index = p.probe_id % 89
      LEFT JOIN media m ON m.media_id = p.media_id) s""",
)
def frame_step(spark, folder):
    steps = probes(spark, folder).select(
        "probe_id", "media_id", (F.col("probe_id") % 89).alias("presentation_index"), (F.col("probe_id") % 41 - 20).alias("step")
    )
    return T.step_frames(steps, samples(spark, folder)).select("probe_id", known("reached.presentation_index").alias("frame"))


@query(
    "next_frames",
    with_(EVENTS, PROBES)
    + """SELECT p.probe_id, t.presentation_index - s.presentation_index AS ordinal, t.presentation_index AS frame
    FROM probes p JOIN samples s ON s.media_id = p.media_id AND s.presentation_index = p.probe_id % 89
    JOIN samples t ON t.media_id = s.media_id AND t.presentation_index > s.presentation_index
      AND t.presentation_index <= s.presentation_index + p.probe_id % 5""",
)
def next_frames(spark, folder):
    starts = probes(spark, folder).select(
        "probe_id", "media_id", (F.col("probe_id") % 89).alias("presentation_index"), (F.col("probe_id") % 5).alias("count")
    )
    out = T.next_frames(starts, samples(spark, folder))
    return out.select("probe_id", "ordinal", F.col("frame.presentation_index").alias("frame"))


CUT = """cut AS (SELECT * FROM samples WHERE event_type <> 'error'),
co AS (SELECT *, LAG(presentation_index) OVER w AS pi, LAG(pt_ns) OVER w AS pt,
  ROW_NUMBER() OVER w - 1 AS pos FROM cut WINDOW w AS (PARTITION BY media_id ORDER BY pt_ns, presentation_index))"""


@query(
    "contiguity",
    with_(EVENTS, CUT)
    + """SELECT media_id, presentation_index,
      CASE WHEN pi IS NULL OR (presentation_index = pi + 1 AND pt_ns > pt) THEN 1 ELSE 0 END AS contiguous FROM co""",
)
def contiguity(spark, folder):
    s = samples(spark, folder)
    out = T.contiguity(s.to(s.df.where("event_type <> 'error'")))
    return out.select("media_id", "presentation_index", F.col("contiguous").cast("bigint").alias("contiguous"))


@query(
    "frame_lookup",
    with_(EVENTS, PROBES)
    + """SELECT probe_id, COALESCE(s.pt_ns, -1) AS time_ns
    FROM probes p LEFT JOIN samples s ON s.media_id = p.media_id AND s.presentation_index = p.index_hint""",
)
def frame_lookup(spark, folder):
    wanted = probes(spark, folder).select(
        "probe_id", "media_id", F.col("index_hint").alias("presentation_index"),
        F.lit(None).cast("bigint").alias("pts"), F.lit(1).cast("bigint").alias("serial"),
    )
    return T.locate_frames(wanted, samples(spark, folder).plain()).select("probe_id", known("time_ns").alias("time_ns"))


@query(
    "rows_in_ranges",
    with_(EVENTS, RANGES)
    + """SELECT range_id, COUNT(*) AS n, MIN(presentation_index) AS lo, MAX(presentation_index) AS hi
    FROM ranges r JOIN samples s ON s.media_id = r.media_id AND s.pt_ns BETWEEN r.start_ns AND r.end_ns GROUP BY 1""",
)
def rows_in_ranges(spark, folder):
    rows = R.rows_in_ranges(samples(spark, folder).plain().select("media_id", "pt_ns", "presentation_index"), ranges(spark, folder))
    return rows.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("presentation_index").alias("lo"), F.max("presentation_index").alias("hi")
    )


@query(
    "first_rows_in_ranges",
    with_(EVENTS, RANGES)
    + """SELECT range_id, ordinal, presentation_index FROM (
      SELECT range_id, presentation_index, ROW_NUMBER() OVER (PARTITION BY range_id ORDER BY pt_ns, presentation_index) AS ordinal
      FROM ranges r JOIN samples s ON s.media_id = r.media_id AND s.pt_ns BETWEEN r.start_ns AND r.end_ns) WHERE ordinal <= 2""",
)
def first_rows_in_ranges(spark, folder):
    s = samples(spark, folder)
    out = R.first_rows_in_ranges(ranges(spark, folder), s.to(s.df.select(*s.columns("media_id", "pt_ns", "presentation_index", "pts"))), 2)
    return out.select("range_id", "ordinal", "presentation_index")


@query(
    "range_summary",
    with_(EVENTS, RANGES, CUT, """fr AS (SELECT media_id, presentation_index AS f, pt_ns AS ft FROM samples),
    every AS (SELECT media_id, start_ns, end_ns, range_id FROM ranges
      UNION ALL SELECT a.media_id, a.ft, b.ft, 'f' || a.media_id || ':' || a.f FROM fr a JOIN fr b ON b.media_id = a.media_id AND b.f = a.f + 3)""")
    + """SELECT range_id, COALESCE(MIN(s.presentation_index), -1) AS first_frame, COALESCE(MAX(s.presentation_index), -1) AS last_frame,
      COUNT(s.pt_ns) AS known_count,
      CASE WHEN COUNT(s.pt_ns) > 0 AND MAX(s.presentation_index) - MIN(s.presentation_index) + 1 = COUNT(s.pt_ns)
        AND MIN(s.pt_ns) = ANY_VALUE(start_ns) AND MAX(s.pt_ns) = ANY_VALUE(end_ns) THEN COUNT(s.pt_ns) ELSE -1 END AS frame_count
    FROM every r LEFT JOIN cut s ON s.media_id = r.media_id AND s.pt_ns BETWEEN r.start_ns AND r.end_ns GROUP BY 1""",
)
def range_summary(spark, folder):
    """Ranges of line items plus ranges between frames, over frames with the errors left out."""
    s = samples(spark, folder)
    f = s.plain().select("media_id", F.col("presentation_index").alias("f"), F.col("pt_ns").alias("start_ns"))
    to = f.select("media_id", (F.col("f") - 3).alias("f"), F.col("start_ns").alias("end_ns"))
    framed = f.join(to, ["media_id", "f"]).withColumn(
        "range_id", F.concat(F.lit("f"), F.col("media_id"), F.lit(":"), F.col("f"))
    ).drop("f")
    every = ranges(spark, folder).unionByName(framed)
    cut = s.to(s.df.where("event_type <> 'error'").select(*s.columns("media_id", "pt_ns", "presentation_index", "pts")))
    return R.range_summary(every, cut).select(
        "range_id", known("first_frame").alias("first_frame"), known("last_frame").alias("last_frame"),
        "known_count", known("frame_count").alias("frame_count"),
    )


@query(
    "adjacent_marker",
    with_(EVENTS, PROBES)
    + """SELECT probe_id, kind, COALESCE(MAX(CASE WHEN s.pt_ns < target_ns THEN s.pt_ns END), -1) AS previous_ns,
      COALESCE(MIN(CASE WHEN s.pt_ns > target_ns THEN s.pt_ns END), -1) AS next_ns
    FROM (SELECT *, CASE WHEN probe_id % 2 = 0 THEN 'signup' ELSE 'error' END AS kind FROM probes) p
    LEFT JOIN samples s ON s.media_id = p.media_id AND s.event_type = p.kind GROUP BY 1, 2""",
)
def adjacent_marker(spark, folder):
    markers = samples(spark, folder).plain().select(
        "media_id", F.col("event_type").alias("kind"), F.col("pt_ns").alias("time_ns"), F.col("pts").alias("marker_id")
    )
    p = probes(spark, folder).withColumn("kind", F.when(F.col("probe_id") % 2 == 0, "signup").otherwise("error"))
    out = S.adjacent_marker(p, markers)
    return out.select("probe_id", "kind", known("previous_ns").alias("previous_ns"), known("next_ns").alias("next_ns"))
