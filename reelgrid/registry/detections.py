"""Detection queries."""

from __future__ import annotations

from ..operators import detect as D
from .base import DETECT, EVENTS, dbl, known, query, samples, with_

CANDIDATES = """
nb AS (
  SELECT *, CASE WHEN presentation_index > 1 THEN COALESCE(LAG(scene_score) OVER w, 0) ELSE 0 END AS before,
         COALESCE(LEAD(scene_score) OVER w, 0) AS after
  FROM samples WINDOW w AS (PARTITION BY media_id ORDER BY presentation_index)),
cand AS (
  SELECT media_id, presentation_index, pt_ns, duration_ns,
         CASE WHEN presentation_index = 0 THEN CAST(1 AS FLOAT) ELSE scene_score END AS score
  FROM nb WHERE presentation_index = 0
     OR (scene_score >= CAST(0.45 AS FLOAT) AND scene_score >= before AND scene_score >= after)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY presentation_index) AS rn FROM cand)"""

SCENES = CANDIDATES + """,
walk AS (
  SELECT media_id, rn, presentation_index AS i, pt_ns AS t, duration_ns AS d, score, pt_ns AS t0, 1 AS no
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT c.media_id, c.rn,
    CASE WHEN take THEN c.presentation_index ELSE w.i END, CASE WHEN take THEN c.pt_ns ELSE w.t END,
    CASE WHEN take THEN c.duration_ns ELSE w.d END, CASE WHEN take THEN c.score ELSE w.score END, w.t0,
    CASE WHEN push THEN w.no + 1 ELSE w.no END
  FROM (
    SELECT w.media_id, w.rn, w.i, w.t, w.d, w.score, w.t0, w.no,
      c.pt_ns - w.t >= 43200000000000 AS push,
      c.pt_ns - w.t >= 43200000000000 OR (w.score < c.score AND w.t <> w.t0) AS take
    FROM walk w JOIN ranked c ON c.media_id = w.media_id AND c.rn = w.rn + 1) w
  JOIN ranked c ON c.media_id = w.media_id AND c.rn = w.rn + 1),
scenes AS (
  SELECT media_id, no, MAX_BY(i, rn) AS frame, MAX_BY(t, rn) AS start_ns,
         MAX_BY(t + GREATEST(d, 1), rn) AS end_ns, MAX_BY(score, rn) AS score
  FROM walk GROUP BY 1, 2)"""

RUNS = """
sp AS (
  SELECT *, LAG(content_hash) OVER w = content_hash AS same, LAG(pt_ns) OVER w AS p_ns,
         LAG(presentation_index) OVER w AS p_i
  FROM samples WINDOW w AS (PARTITION BY media_id ORDER BY presentation_index)),
kd AS (
  SELECT *, CASE WHEN duplicate_score >= CAST(0.985 AS FLOAT) THEN
           CASE WHEN same THEN 'exact_duplicate' ELSE 'near_duplicate' END END AS dk,
         CASE WHEN duplicate_score >= CAST(0.995 AS FLOAT) THEN 'freeze' END AS fk FROM sp),
fl AS (
  SELECT *, CASE WHEN dk IS DISTINCT FROM LAG(dk) OVER w THEN 1 ELSE 0 END AS db,
         CASE WHEN fk IS DISTINCT FROM LAG(fk) OVER w THEN 1 ELSE 0 END AS fb
  FROM kd WINDOW w AS (PARTITION BY media_id ORDER BY presentation_index)),
ids AS (
  SELECT *, SUM(db) OVER w AS did, SUM(fb) OVER w AS fid
  FROM fl WINDOW w AS (PARTITION BY media_id ORDER BY presentation_index)),
dups AS (
  SELECT media_id, dk AS kind, MIN(p_ns) AS start_ns, MAX_BY(pt_ns + GREATEST(duration_ns, 1), presentation_index) AS end_ns,
         MIN(p_i) AS first_frame, MAX(presentation_index) AS last_frame, COUNT(*) + 1 AS frame_count,
         AVG(CAST(duplicate_score AS DOUBLE)) AS score
  FROM ids WHERE dk IS NOT NULL GROUP BY media_id, dk, did),
frz AS (
  SELECT media_id, fk AS kind, MIN(p_ns) AS start_ns, MAX_BY(pt_ns + GREATEST(duration_ns, 1), presentation_index) AS end_ns,
         MIN(p_i) AS first_frame, MAX(presentation_index) AS last_frame, COUNT(*) + 1 AS frame_count,
         AVG(CAST(duplicate_score AS DOUBLE)) AS score
  FROM ids WHERE fk IS NOT NULL GROUP BY media_id, fk, fid HAVING COUNT(*) + 1 >= 3)"""

SEEDS = """
sd AS (
  SELECT a.media_id, a.presentation_index AS cur, b.presentation_index AS prev, a.pt_ns - b.pt_ns AS gap,
         ROW_NUMBER() OVER (PARTITION BY a.media_id, a.presentation_index ORDER BY b.presentation_index DESC) AS back
  FROM samples a JOIN samples b ON a.media_id = b.media_id AND a.perceptual_hash = b.perceptual_hash
   AND b.presentation_index < a.presentation_index),
seeds AS (SELECT media_id, cur, prev FROM sd WHERE back <= 8 AND gap >= 2000000000)"""

REPEATS = SEEDS + """,
brk AS (
  SELECT s.media_id, s.cur, s.prev, MIN(x.presentation_index) AS stop
  FROM seeds s JOIN samples x ON x.media_id = s.media_id AND x.presentation_index > s.cur
  JOIN samples y ON y.media_id = s.media_id AND y.presentation_index = x.presentation_index - s.cur + s.prev
  WHERE x.perceptual_hash <> y.perceptual_hash GROUP BY 1, 2, 3),
sized AS (
  SELECT s.media_id, s.cur, s.prev, LEAST(COALESCE(stop, n) - s.cur, s.cur - s.prev) AS len
  FROM seeds s JOIN media m USING (media_id) LEFT JOIN brk USING (media_id, cur, prev)),
best AS (
  SELECT media_id, cur, MAX(len) AS len, MAX_BY(prev, len * 100000 + prev) AS prev
  FROM sized WHERE len >= 2 GROUP BY 1, 2),
bn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY cur) AS rn FROM best),
rw AS (
  SELECT media_id, rn, cur, len, prev, TRUE AS taken, cur + len AS until FROM bn WHERE rn = 1
  UNION ALL
  SELECT b.media_id, b.rn, b.cur, b.len, b.prev, b.cur >= r.until,
         CASE WHEN b.cur >= r.until THEN b.cur + b.len ELSE r.until END
  FROM rw r JOIN bn b ON b.media_id = r.media_id AND b.rn = r.rn + 1),
reps AS (
  SELECT r.media_id, 'repeated_section' AS kind, x.pt_ns AS start_ns,
         GREATEST(x.pt_ns, y.pt_ns + GREATEST(y.duration_ns, 1)) AS end_ns, r.cur AS first_frame,
         r.cur + len - 1 AS last_frame, len AS frame_count, CAST(1 AS DOUBLE) AS score,
         r.prev AS match_first_frame, r.prev + len - 1 AS match_last_frame
  FROM rw r JOIN samples x ON x.media_id = r.media_id AND x.presentation_index = r.cur
  JOIN samples y ON y.media_id = r.media_id AND y.presentation_index = r.cur + len - 1 WHERE taken)"""

COLUMNS = "media_id, kind, start_ns, end_ns, first_frame, last_frame, frame_count, ROUND(CAST(score AS DOUBLE), 5) AS score"
SCENE_ROWS = "SELECT media_id, 'scene' AS kind, start_ns, end_ns, frame AS first_frame, frame AS last_frame, 1 AS frame_count, score FROM scenes"


def _recursive(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _out(df, match=False):
    extra = [known("match_first_frame").alias("match_first_frame"), known("match_last_frame").alias("match_last_frame")]
    return df.select(
        "media_id", "kind", "start_ns", "end_ns", known("first_frame").alias("first_frame"),
        known("last_frame").alias("last_frame"), "frame_count", dbl("score", 5).alias("score"), *(extra if match else []),
    )


@query(
    "scene_candidates",
    with_(EVENTS, CANDIDATES)
    + "SELECT media_id, presentation_index AS first_frame, pt_ns AS start_ns, ROUND(CAST(score AS DOUBLE), 6) AS score FROM cand",
)
def scene_candidates(spark, folder):
    c = D.scene_candidates(D.prepare(samples(spark, folder)), DETECT)
    return c.df.select("media_id", "first_frame", "start_ns", dbl("score").alias("score"))


@query("scenes", _recursive(EVENTS, SCENES) + f"SELECT {COLUMNS} FROM ({SCENE_ROWS})")
def scenes(spark, folder):
    return _out(D.scenes(D.prepare(samples(spark, folder)), DETECT))


@query("duplicate_ranges", with_(EVENTS, RUNS) + f"SELECT {COLUMNS} FROM dups")
def duplicate_ranges(spark, folder):
    return _out(D.duplicate_ranges(D.prepare(samples(spark, folder)), DETECT))


@query("freezes", with_(EVENTS, RUNS) + f"SELECT {COLUMNS} FROM frz")
def freezes(spark, folder):
    return _out(D.freezes(D.prepare(samples(spark, folder)), DETECT))


@query("repeat_seeds", with_(EVENTS, SEEDS) + "SELECT media_id, cur, prev FROM seeds")
def repeat_seeds(spark, folder):
    return D.repeat_seeds(D.prepare(samples(spark, folder)), DETECT)


@query(
    "repeated_sections",
    _recursive(EVENTS, REPEATS) + f"SELECT {COLUMNS}, match_first_frame, match_last_frame FROM reps",
)
def repeated_sections(spark, folder):
    return _out(D.repeated_sections(D.prepare(samples(spark, folder)), DETECT), match=True)


ALL = f"""{SCENE_ROWS} UNION ALL SELECT media_id, kind, start_ns, end_ns, first_frame, last_frame, frame_count, score FROM dups
  UNION ALL SELECT * FROM frz
  UNION ALL SELECT media_id, kind, start_ns, end_ns, first_frame, last_frame, frame_count, score FROM reps"""


@query("detections", _recursive(EVENTS, SCENES, RUNS, REPEATS) + f"SELECT {COLUMNS} FROM ({ALL})")
def detections(spark, folder):
    return _out(D.detect(samples(spark, folder), DETECT))


@query(
    "detection_summary",
    _recursive(EVENTS, SCENES, RUNS, REPEATS, f"every AS ({ALL})")
    + """SELECT m.media_id, ANY_VALUE(n) AS analysed, COUNT(CASE WHEN kind = 'scene' THEN 1 END) AS scene_count,
      COUNT(CASE WHEN kind IN ('exact_duplicate', 'near_duplicate', 'repeated_section') THEN 1 END) AS duplicate_count,
      COUNT(CASE WHEN kind = 'freeze' THEN 1 END) AS freeze_count
    FROM media m LEFT JOIN every e ON e.media_id = m.media_id GROUP BY m.media_id""",
)
def detection_summary(spark, folder):
    s = samples(spark, folder)
    return D.detection_summary(D.detect(s, DETECT), s.df)


@query(
    "detections_capped",
    _recursive(
        EVENTS, SCENES, RUNS,
        """cs AS (SELECT media_id, kind, first_frame, last_frame FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY start_ns, first_frame) AS r
             FROM dups) WHERE r <= 4
           UNION ALL SELECT media_id, kind, first_frame, last_frame FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY start_ns, first_frame) AS r
             FROM frz) WHERE r <= 4
           UNION ALL SELECT media_id, 'scene', CASE WHEN no < 4 THEN frame ELSE i END, CASE WHEN no < 4 THEN frame ELSE i END
             FROM scenes JOIN (SELECT media_id, no, MIN_BY(i, rn) AS i FROM walk GROUP BY 1, 2) USING (media_id, no) WHERE no <= 4)""",
    )
    + "SELECT media_id, kind, first_frame, last_frame FROM cs",
)
def detections_capped(spark, folder):
    """At most four results per kind; the cap also ends replacement of the last scene."""
    from dataclasses import replace

    out = D.detect(samples(spark, folder), replace(DETECT, results_per_kind=4), repeated=False)
    return out.select("media_id", "kind", "first_frame", "last_frame")
