"""Selection plans, sheets, strips and manifests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import naming as N
from ..functions import spacing as G
from ..functions.timebase import format_timestamp
from ..plans import manifest as X
from ..plans import requests as Q
from ..plans import selection as P
from ..plans import sheets as H
from ..plans import strips as W
from ..session import scratch
from ..sources import tables as IO
from .base import BRACKET, EVENTS, PROBES, RANGES, few_ranges, known, probes, query, ranges, samples, with_
from .detections import SCENES, _recursive
from .lookups import CUT

REQUESTS = """
req AS (
  SELECT r.range_id AS request_id, r.media_id, LEAST(start_ns, d) AS s0, LEAST(end_ns, d) AS e0, d,
         1 + start_ns // 1000000000000 % 3 AS every_n, 2 + start_ns // 1000000000000 % 4 AS max_frames
  FROM ranges r JOIN (SELECT media_id, duration_ns AS d, n FROM media) m USING (media_id)),
requests AS (SELECT *, s0 AS s, CASE WHEN s0 = e0 AND d > s0 THEN d ELSE e0 END AS e FROM req)"""


def requests(spark, folder, s):
    """One request per line item range, normalised."""
    media = A.media_from_samples(s)
    day = F.call_function("div", F.col("start_ns"), F.lit(A.DAY_NS))
    raw = ranges(spark, folder).join(media.select("media_id"), "media_id", "left_semi").select(
        F.col("range_id").alias("request_id"), "media_id",
        F.lit("png").alias("format"), F.concat(F.lit(" clip:"), F.col("media_id"), F.lit(". ")).alias("base_name"),
        F.col("start_ns").alias("anchor_ns"),
        # Ends swapped on purpose; normalisation puts them in order.
        F.col("end_ns").alias("range_start_ns"), F.col("start_ns").alias("range_end_ns"),
        (1 + day % 3).alias("every_n"), (2 + day % 4).alias("max_frames"), F.lit(140).alias("quality"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("end_ns") - i * (F.col("end_ns") - F.col("start_ns")) / 5).cast("array<bigint>").alias("target_times"),
        F.struct(
            F.lit("range").alias("source"), F.lit(2).alias("rows"), F.lit(2).alias("columns"), F.lit(4).alias("frame_count"),
            F.lit(320).alias("cell_w"), F.lit(180).alias("cell_h"), F.lit(True).alias("with_time"), F.lit(True).alias("with_index"),
        ).alias("sheet"),
    )
    return Q.normalise_requests(raw, media), media


@query(
    "export_requests",
    with_(EVENTS, RANGES, REQUESTS)
    + """SELECT request_id, s AS range_start_ns, e AS range_end_ns, s0 AS anchor_ns, every_n, max_frames, 100 AS quality,
      'clip_' || media_id AS base_name FROM requests""",
)
def export_requests(spark, folder):
    r, _ = requests(spark, folder, samples(spark, folder))
    return r.select(
        "request_id", "range_start_ns", "range_end_ns", "anchor_ns", F.col("every_n").cast("bigint").alias("every_n"),
        F.col("max_frames").cast("bigint").alias("max_frames"), F.col("quality").cast("bigint").alias("quality"), "base_name",
    )


@query(
    "estimated_total",
    with_(EVENTS, RANGES, REQUESTS)
    + """SELECT request_id, CASE WHEN d > 0 THEN LEAST((n * CAST(LEAST(e - s, d) AS HUGEINT) + d * every_n - 1) // (CAST(d AS HUGEINT) * every_n), max_frames)
      ELSE 0 END AS estimated_total FROM requests JOIN (SELECT media_id, n FROM media) USING (media_id)""".replace("d * every_n - 1", "CAST(d AS HUGEINT) * every_n - 1"),
)
def estimated_total(spark, folder):
    r, media = requests(spark, folder, samples(spark, folder))
    return Q.estimated_total(r, media).select("request_id", F.col("estimated_total").cast("bigint").alias("estimated_total"))


PLAN = """
inside AS (
  SELECT q.request_id, q.media_id, every_n, max_frames, x.presentation_index, x.pt_ns, x.key_frame,
         ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY x.presentation_index) - 1 AS c
  FROM requests q JOIN samples x ON x.media_id = q.media_id AND x.pt_ns BETWEEN s AND e),
chosen AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY presentation_index) AS seq, COUNT(*) OVER (PARTITION BY request_id) AS total
  FROM inside WHERE {which})"""


@query(
    "frame_range_plan",
    with_(EVENTS, RANGES, REQUESTS, PLAN.format(which="c % every_n = 0"))
    + "SELECT request_id, seq, presentation_index, CASE WHEN total > max_frames THEN 1 ELSE 0 END AS limit_reached FROM chosen WHERE seq <= max_frames",
)
def frame_range_plan(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    out = P.range_plan(r, s, few=few_ranges(spark, folder, 1))
    return out.select("request_id", "seq", "presentation_index", F.col("limit_reached").cast("bigint").alias("limit_reached"))


@query(
    "keyframe_plan",
    with_(EVENTS, RANGES, REQUESTS, PLAN.format(which="key_frame"))
    + "SELECT request_id, seq, presentation_index, CASE WHEN total > max_frames THEN 1 ELSE 0 END AS limit_reached FROM chosen WHERE seq <= max_frames",
)
def keyframe_plan(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    out = P.range_plan(r, s, keyframes=True, few=few_ranges(spark, folder, 1))
    return out.select("request_id", "seq", "presentation_index", F.col("limit_reached").cast("bigint").alias("limit_reached"))


@query(
    "manifest",
    with_(EVENTS, RANGES, REQUESTS, PLAN.format(which="c % every_n = 0"))
    + """SELECT request_id, 'clip_' || media_id || '_' || lpad(CAST(seq AS VARCHAR), 6, '0') || '_f'
      || lpad(CAST(presentation_index AS VARCHAR), 8, '0') || '.png' AS file_name FROM chosen WHERE seq <= max_frames""",
)
def manifest(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    return X.manifest(P.range_plan(r, s, keep=("base_name", "format"), few=few_ranges(spark, folder, 1))).select("request_id", "file_name")


@query(
    "stored_manifest",
    with_(EVENTS, RANGES, REQUESTS, PLAN.format(which="c % every_n = 0"))
    + "SELECT request_id, COUNT(*) AS files, MAX(seq) AS last FROM chosen WHERE seq <= max_frames GROUP BY 1",
)
def stored_manifest(spark, folder):
    """Manifests stored twice, whole, the first time with other names, and once more without being published."""
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    path, made = scratch(spark, "manifest"), scratch(spark, "plan")
    # Planned once: three versions are written of it, each read twice, for its ranges of keys and for its rows.
    X.manifest(P.range_plan(r, s, keep=("base_name", "format"), few=few_ranges(spark, folder, 1))).withColumn("kind", F.lit("png")).write.parquet(made)
    rows = spark.read.parquet(made)
    IO.write_results(rows.withColumn("kind", F.lit("old")), path, whole=True)
    IO.write_results(rows, path, order=("seq",), whole=True)
    IO.write_results(rows, path, order=("seq",), publish=False)
    return IO.read_results(spark, path).groupBy("request_id").agg(F.count(F.lit(1)).alias("files"), F.max("seq").cast("bigint").alias("last"))


@query(
    "manifest_summary",
    with_(EVENTS, RANGES, REQUESTS, PLAN.format(which="c % every_n = 0"))
    + """SELECT q.request_id, CASE WHEN MAX(total) IS NULL THEN 0 ELSE LEAST(MAX(total), ANY_VALUE(q.max_frames)) END AS files,
      COALESCE(CASE WHEN MAX(total) > ANY_VALUE(q.max_frames) THEN 'frame_limit'
        WHEN MAX(total) IS NULL THEN 'no_frames' END, '') AS detail
    FROM requests q LEFT JOIN chosen c ON c.request_id = q.request_id GROUP BY 1""",
)
def manifest_summary(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    out = X.manifest_summary(P.range_plan(r, s, few=few_ranges(spark, folder, 1)), r)
    return out.select("request_id", "files", F.coalesce("detail", F.lit("")).alias("detail"))


@query("every_n", with_(EVENTS) + "SELECT media_id, presentation_index FROM samples WHERE presentation_index % 7 = 0")
def every_n(spark, folder):
    return P.every_nth(samples(spark, folder), 7).select("media_id", "presentation_index")


@query(
    "high_motion_plan",
    with_(EVENTS)
    + """SELECT media_id, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY presentation_index) AS seq, presentation_index
    FROM samples WHERE motion >= CAST(0.3 AS FLOAT)""",
)
def high_motion_plan(spark, folder):
    s = samples(spark, folder)
    out = P.media_target_plan(P.high_motion_targets(s, 0.3), s)
    return out.select("media_id", "seq", "presentation_index")


@query(
    "scene_plan",
    _recursive(EVENTS, SCENES)
    + """SELECT media_id, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY frame) AS seq, frame AS presentation_index FROM scenes""",
)
def scene_plan(spark, folder):
    from ..operators import detect as D
    from .base import DETECT

    s = samples(spark, folder)
    found = D.scenes(D.prepare(s), DETECT)
    out = P.media_target_plan(P.scene_targets(found), s)
    return out.select("media_id", "seq", "presentation_index")


TIMES = """
tt AS (
  SELECT DISTINCT q.request_id, q.media_id, LEAST(CAST(e1 - i * (e1 - s1) / 5.0::DOUBLE AS BIGINT), q.d) AS target_ns, q.max_frames
  FROM (SELECT q.*, r.start_ns AS s1, r.end_ns AS e1 FROM requests q JOIN ranges r ON r.range_id = q.request_id) q,
       generate_series(0, 5) AS g(i)),
tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY target_ns) AS k FROM tt),
probes AS (SELECT * FROM tr WHERE k <= max_frames)"""


@query(
    "target_plan",
    with_(EVENTS, RANGES, REQUESTS, TIMES, BRACKET)
    + """SELECT request_id, i AS presentation_index, MIN(p.target_ns) AS target_ns,
      ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY MIN(p.target_ns)) AS seq
    FROM probes p JOIN near USING (media_id, target_ns) WHERE i IS NOT NULL GROUP BY 1, 2""",
)
def target_plan(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    return P.target_plan(r, s, few_ranges(spark, folder, 6)).select("request_id", "presentation_index", "target_ns", "seq")


SHEET = """
cells AS (
  SELECT q.request_id, q.media_id, CASE WHEN e <= s THEN s ELSE s + (e - s) // 3 * g.i + (e - s) % 3 * g.i // 3 END AS target_ns
  FROM requests q, generate_series(0, 3) AS g(i) WHERE e > s OR g.i = 0),
probes AS (SELECT DISTINCT * FROM cells)"""


@query(
    "overview_sheet",
    with_(EVENTS, RANGES, REQUESTS, SHEET, BRACKET, """
    kept AS (SELECT request_id, media_id, near.i AS f, MIN(p.target_ns) AS t FROM probes p JOIN near USING (media_id, target_ns)
      WHERE near.i IS NOT NULL GROUP BY 1, 2, 3),
    numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY t) - 1 AS cell FROM kept)""")
    + """SELECT request_id, cell, cell // 2 AS row, cell % 2 AS "column", f AS presentation_index,
      lpad(CAST(ms // 3600000 AS VARCHAR), CAST(GREATEST(2, LENGTH(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '  |  Frame ' || f AS label
    FROM (SELECT n.*, x.pt_ns // 1000000 AS ms FROM numbered n JOIN samples x ON x.media_id = n.media_id AND x.presentation_index = f)""",
)
def overview_sheet(spark, folder):
    s = samples(spark, folder)
    r, _ = requests(spark, folder, s)
    r = r.withColumn("target_times", F.array().cast("array<bigint>"))
    return H.overview_sheet(r, s, few_ranges(spark, folder, 4)).select("request_id", "cell", "row", "column", "presentation_index", "label")


@query(
    "sheet_subsample",
    with_(EVENTS, RANGES, REQUESTS, TIMES, """
    sized AS (SELECT *, COUNT(*) OVER (PARTITION BY request_id) AS m FROM probes),
    spots AS (SELECT DISTINCT request_id, m, g.i, CASE WHEN m <= 3 THEN g.i ELSE (m - 1) // 2 * g.i + (m - 1) % 2 * g.i // 2 END AS at_
      FROM sized, generate_series(0, 2) AS g(i) WHERE g.i < m)""")
    + """SELECT s.request_id, s.i AS position, p.target_ns FROM spots s JOIN sized p ON p.request_id = s.request_id AND p.k = s.at_ + 1""",
)
def sheet_subsample(spark, folder):
    """Three of the target times of each request, evenly spaced among them."""
    r, _ = requests(spark, folder, samples(spark, folder))
    picked = r.select("request_id", F.posexplode(P.subsample(F.col("target_times"), F.lit(3))).alias("position", "target_ns"))
    return picked.select("request_id", F.col("position").cast("bigint").alias("position"), "target_ns")


@query(
    "single_frame",
    with_(EVENTS, PROBES, BRACKET)
    + """SELECT probe_id, COALESCE(CASE probe_id % 3 WHEN 0 THEN i WHEN 1 THEN CASE WHEN i > 0 THEN i - 1 END
      ELSE CASE WHEN i < n - 1 THEN i + 1 END END, -1) AS frame
    FROM probes LEFT JOIN near USING (media_id, target_ns) LEFT JOIN media USING (media_id)""",
)
def single_frame(spark, folder):
    kind = F.element_at(F.array(F.lit("current"), F.lit("previous"), F.lit("next")), (F.col("probe_id") % 3 + 1).cast("int"))
    r = probes(spark, folder).select("probe_id", "media_id", F.col("target_ns").alias("anchor_ns"), kind.alias("relative"))
    return P.single_frame(r, samples(spark, folder)).select("probe_id", known("frame.presentation_index").alias("frame"))


STRIP = """
sr AS (SELECT r.range_id AS request_id, r.media_id, start_ns AS s, end_ns AS e, CASE WHEN start_ns // 1000000000000 % 50 = 0 THEN 75 ELSE 1 + start_ns // 1000000000000 % 5 END AS c, (start_ns * 2 + end_ns) // 3 AS playhead FROM ranges r),
st AS (
  SELECT DISTINCT request_id, media_id, playhead,
    CASE WHEN c = 1 OR e <= s THEN s + (e - s) // 2 ELSE s + (e - s) // (c - 1) * i + (e - s) % (c - 1) * i // (c - 1) END AS target_ns
  FROM sr, generate_series(0, 74) AS g(i) WHERE i < c),
probes AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY target_ns) - 1 AS ordinal,
  ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ABS(target_ns - playhead), target_ns) AS closeness FROM st)"""


@query(
    "even_frame_sample",
    with_(EVENTS, RANGES, STRIP, BRACKET)
    + """SELECT request_id, ordinal, target_ns, COALESCE(i, -1) AS index_hint, CASE WHEN closeness = 1 THEN 1 ELSE 0 END AS current
    FROM probes LEFT JOIN near USING (media_id, target_ns)""",
)
def even_frame_sample(spark, folder):
    day = F.call_function("div", F.col("start_ns"), F.lit(A.DAY_NS))
    r = ranges(spark, folder).select(
        F.col("range_id").alias("request_id"), "media_id", "start_ns", "end_ns",
        F.when(day % 50 == 0, 75).otherwise(1 + day % 5).alias("count"),
        F.call_function("div", F.col("start_ns") * 2 + F.col("end_ns"), F.lit(3)).alias("probe_ns"),
    )
    out = W.even_sample(r, samples(spark, folder), few=few_ranges(spark, folder, 75))
    return out.select(
        "request_id", F.col("ordinal").cast("bigint").alias("ordinal"), "target_ns", known("index_hint").alias("index_hint"),
        F.col("current").cast("bigint").alias("current"),
    )


WINDOWS = """
few AS (SELECT DISTINCT media_id, target_ns FROM probes),
nr AS (SELECT media_id, target_ns, i AS frame FROM cutnear),
fp AS (SELECT f.media_id, f.target_ns, c.pos, t.total FROM few f JOIN nr USING (media_id, target_ns)
  JOIN co c ON c.media_id = f.media_id AND c.presentation_index = nr.frame
  JOIN (SELECT media_id, COUNT(*) AS total FROM cut GROUP BY 1) t ON t.media_id = f.media_id),
ws AS (SELECT media_id, target_ns, LEAST(GREATEST(pos - 2, 0), total - 4) AS st FROM fp WHERE total >= 4),
wx AS (
  SELECT w.media_id, w.target_ns, w.st, SUM(CASE WHEN c.pos > w.st AND NOT (c.presentation_index = c.pi + 1 AND c.pt_ns > c.pt) THEN 1 ELSE 0 END) AS gaps
  FROM ws w JOIN co c ON c.media_id = w.media_id AND c.pos BETWEEN w.st AND w.st + 3 GROUP BY 1, 2, 3)"""


# Windows that are not exact: four times, spaced as the frames around are, and kept inside the media.
SPACED = """
lp AS (SELECT p.probe_id, p.media_id, p.target_ns AS probe_ns, fp.pos, m.duration_ns AS total FROM probes p JOIN media m USING (media_id)
  LEFT JOIN fp ON fp.media_id = p.media_id AND fp.target_ns = p.target_ns
  LEFT JOIN wx ON wx.media_id = p.media_id AND wx.target_ns = p.target_ns WHERE gaps IS NULL OR gaps > 0),
sp AS (SELECT a.media_id, a.pos, list_sort(list(x.duration_ns)) AS ds FROM (SELECT DISTINCT media_id, pos FROM lp WHERE pos IS NOT NULL) a
  JOIN co x ON x.media_id = a.media_id AND x.pos BETWEEN GREATEST(a.pos - 64, 0) AND GREATEST(a.pos - 64, 0) + 128 WHERE x.duration_ns > 0 GROUP BY 1, 2),
lg AS (SELECT lp.*, CASE WHEN o.duration_ns > 0 THEN o.duration_ns ELSE COALESCE(ds[len(ds) // 2 + 1], 40000000) END AS gap FROM lp
  LEFT JOIN co o ON o.media_id = lp.media_id AND o.pos = lp.pos LEFT JOIN sp ON sp.media_id = lp.media_id AND sp.pos = lp.pos),
lx AS (SELECT DISTINCT probe_id, media_id, CASE WHEN gap * 3 < total
    THEN LEAST(CASE WHEN probe_ns > gap * 2 THEN probe_ns - gap * 2 ELSE 0 END, total - gap * 3) + gap * i
    WHEN total <= 0 THEN 0 ELSE total // 3 * i + total % 3 * i // 3 END AS target_ns FROM lg, generate_series(0, 3) AS g(i)),
ln AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY target_ns) - 1 AS ordinal FROM lx)"""


def _bracket(probes: str, frames: str, prefix: str) -> str:
    """The frames around distinct probe times, with all names of its own."""
    own = re.sub(r"\b(targets|bef|aft|around|near)\b", rf"{prefix}\1", BRACKET)
    return re.sub(r"\bsamples\b", frames, re.sub(r"\bprobes\b", probes, own))


@query(
    "context_window",
    with_(EVENTS, PROBES, CUT, _bracket("probes", "cut", "cut"), WINDOWS, SPACED, _bracket("ln", "cut", "l"))
    + """SELECT p.probe_id, 1 AS exact, c.pos - st AS ordinal, c.pt_ns AS target_ns, c.presentation_index AS index_hint
    FROM probes p JOIN wx USING (media_id, target_ns) JOIN co c ON c.media_id = p.media_id AND c.pos BETWEEN st AND st + 3
    WHERE gaps = 0
    UNION ALL SELECT probe_id, 0, ordinal, target_ns, COALESCE(i, -1) FROM ln LEFT JOIN lnear USING (media_id, target_ns)""",
)
def context_window(spark, folder):
    """Windows of four frames, and of four spaced times where frames (errors are left out of the index) do not follow each other."""
    s = samples(spark, folder)
    cut = s.to(s.df.where("event_type <> 'error'"))
    p = probes(spark, folder).select("probe_id", "media_id", "target_ns", F.lit(4).alias("count"))
    out = W.context_window(p, cut, A.media_from_samples(s))
    return out.select(
        "probe_id", F.col("exact").cast("bigint").alias("exact"), F.col("ordinal").cast("bigint").alias("ordinal"), "target_ns", known("index_hint").alias("index_hint")
    )


@query(
    "local_spacing",
    with_(EVENTS, PROBES, BRACKET, """
    at_ AS (SELECT DISTINCT media_id, target_ns, i AS p FROM near WHERE i IS NOT NULL),
    med AS (
      SELECT a.media_id, a.target_ns, list_sort(list(x.duration_ns)) AS ds FROM at_ a
      JOIN samples x ON x.media_id = a.media_id AND x.presentation_index BETWEEN GREATEST(p - 64, 0) AND GREATEST(p - 64, 0) + 128
      WHERE x.duration_ns > 0 GROUP BY 1, 2)""")
    + """SELECT probe_id, CASE WHEN s.duration_ns > 0 THEN s.duration_ns ELSE COALESCE(ds[len(ds) // 2 + 1], 40000000) END AS spacing_ns
    FROM probes p JOIN at_ a USING (media_id, target_ns) JOIN samples s ON s.media_id = p.media_id AND s.presentation_index = a.p
    LEFT JOIN med m ON m.media_id = p.media_id AND m.target_ns = p.target_ns""",
)
def local_spacing(spark, folder):
    from ..operators.asof import asof
    from ..operators.order import sequence, settle

    o = settle(sequence(samples(spark, folder)))
    p = asof(probes(spark, folder).select("probe_id", "media_id", "target_ns"), o, ["_pos", "duration_ns"])
    p = p.where("hit is not null").withColumns({"_p": F.col("hit._pos"), "_dur": F.col("hit.duration_ns")}).drop("hit")
    return W.local_spacing(p, o.plain()).select("probe_id", "spacing_ns")


@query(
    "evenly_spaced",
    """SELECT o_orderkey, g.i AS position, CASE WHEN n = 1 THEN 0 ELSE o_custkey // (n - 1) * g.i + o_custkey % (n - 1) * g.i // (n - 1) END AS value
    FROM (SELECT *, 1 + o_orderkey % 6 AS n FROM orders), generate_series(0, 5) AS g(i) WHERE g.i < CASE WHEN o_custkey = 0 THEN 1 ELSE n END""",
)
def evenly_spaced(spark, folder):
    o = A.load(spark, folder, "orders")
    values = G.evenly_spaced(F.lit(0), F.col("o_custkey"), 1 + F.col("o_orderkey") % 6)
    return o.select("o_orderkey", F.posexplode(values).alias("position", "value")).select(
        "o_orderkey", F.col("position").cast("bigint").alias("position"), "value"
    )


@query(
    "sheet_grid",
    """SELECT n AS cells, CASE n WHEN 8 THEN 4 WHEN 16 THEN 4 WHEN 20 THEN 5 WHEN 25 THEN 5 ELSE c END AS columns,
      CASE n WHEN 8 THEN 2 WHEN 16 THEN 4 WHEN 20 THEN 4 WHEN 25 THEN 5 ELSE (n + c - 1) // c END AS rows, COUNT(*) AS orders
    FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS c FROM (SELECT 1 + o_orderkey % 40 AS n FROM orders)) GROUP BY 1, 2, 3""",
)
def sheet_grid(spark, folder):
    n = 1 + F.col("o_orderkey") % 40
    o = A.load(spark, folder, "orders").select(
        n.alias("cells"), G.grid_columns(n).cast("bigint").alias("columns"), G.grid_rows(n).cast("bigint").alias("rows")
    )
    return o.groupBy("cells", "columns", "rows").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "timestamps_and_names",
    r"""SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), CAST(GREATEST(2, LENGTH(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS label,
      regexp_replace(trim(props), '[{":}]', '_', 'g') AS name,
      CASE event_type WHEN 'view' THEN 'jpg' WHEN 'click' THEN 'png' WHEN 'error' THEN 'tiff' ELSE 'png' END AS extension,
      CASE event_type WHEN 'view' THEN 'jpeg' WHEN 'error' THEN 'tiff' ELSE '' END AS path_format
    FROM (SELECT *, epoch_us(ts) // 1000 % 100000000 AS ms FROM events)""".replace('[{":}]', '[":]'),
)
def timestamps_and_names(spark, folder):
    e = A.load(spark, folder, "events")
    ms = F.call_function("div", A._micros(F.col("ts")), F.lit(1000)) % 100_000_000
    fmt = F.when(F.col("event_type") == "view", "jpeg").when(F.col("event_type") == "click", "png").when(F.col("event_type") == "error", "tiff").otherwise("raw")
    path = F.when(F.col("event_type") == "view", "a.b/c.JPG").when(F.col("event_type") == "error", "x.tif").otherwise("plain.txt")
    return e.select(
        "event_id", format_timestamp(ms * 1_000_000).alias("label"), N.sanitize_base_name(F.col("props")).alias("name"),
        N.extension(fmt).alias("extension"), F.coalesce(N.format_of_path(path), F.lit("")).alias("path_format"),
    )
