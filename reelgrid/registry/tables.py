"""Time base, metadata, upsert, marker, telemetry and storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..config import SECOND
from ..functions import metadata as M
from ..functions import scores as S
from ..functions import timebase as B
from ..operators import markers as K
from ..operators import samples as U
from ..operators import telemetry as T
from ..schemas import SCHEMAS
from ..session import scratch
from ..sources import tables as IO
from .base import DETECT, EVENTS, RANGES, dbl, known, query, ranges, samples, with_
from .detections import SCENES, _recursive


def _tb(num, den):
    return F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))


RESCALED = """
tk AS (SELECT o_orderkey, o_custkey * 7919 - 3000000 AS ts, o_orderkey % 1000 AS origin, 1 + o_orderkey % 7 AS num,
       CASE o_orderkey % 4 WHEN 0 THEN 90000 WHEN 1 THEN 1000 WHEN 2 THEN 30001 ELSE 48000 END AS den FROM orders)"""


def _ticks(spark, folder):
    o = A.load(spark, folder, "orders")
    den = F.element_at(F.array(*[F.lit(x) for x in (90000, 1000, 30001, 48000)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        "o_orderkey", (F.col("o_custkey") * 7919 - 3_000_000).alias("ts"), (F.col("o_orderkey") % 1000).alias("origin"),
        _tb(1 + F.col("o_orderkey") % 7, den).alias("tb"),
    )


ROUNDED = "CASE WHEN ts < origin THEN -1 ELSE 1 END * ((2 * ABS(CAST(ts - origin AS HUGEINT)) * num * 1000000000 + den) // (2 * den))"


@query("rescale_ns", with_(RESCALED) + f"SELECT o_orderkey, CAST({ROUNDED} AS BIGINT) AS ns FROM tk")
def rescale_ns(spark, folder):
    t = _ticks(spark, folder)
    return t.select("o_orderkey", B.pts_to_ns(F.col("ts"), F.col("origin"), F.col("tb")).alias("ns"))


@query(
    "rescale_pts",
    with_(RESCALED)
    + """SELECT o_orderkey, CAST(origin + CASE WHEN ts < 0 THEN -1 ELSE 1 END
      * ((2 * ABS(CAST(ts AS HUGEINT)) * 1000 * den + CAST(num AS HUGEINT) * 1000000000) // (2 * CAST(num AS HUGEINT) * 1000000000)) AS BIGINT) AS pts FROM tk""",
)
def rescale_pts(spark, folder):
    t = _ticks(spark, folder)
    return t.select("o_orderkey", B.ns_to_pts(F.col("ts") * 1000, F.col("origin"), F.col("tb")).alias("pts"))


@query(
    "nominal_durations",
    """SELECT o_orderkey, CASE WHEN num > 0 THEN (2 * CAST(1000000000 AS BIGINT) * 1001 + num) // (2 * num) ELSE 0 END AS ns
    FROM (SELECT o_orderkey, o_orderkey % 60000 - 5 AS num FROM orders)""",
)
def nominal_durations(spark, folder):
    o = A.load(spark, folder, "orders")
    return o.select("o_orderkey", B.nominal_frame_duration(_tb(F.col("o_orderkey") % 60000 - 5, F.lit(1001))).alias("ns"))


@query(
    "clamped_ranges",
    with_(RANGES)
    + """SELECT range_id, GREATEST(LEAST(LEAST(end_ns, start_ns) - 900000000000000, 1000000000000000), 0) AS lo,
      GREATEST(LEAST(GREATEST(end_ns, start_ns) - 900000000000000, 1000000000000000), 0) AS hi FROM ranges""",
)
def clamped_ranges(spark, folder):
    """Range ends in reverse, shifted and clamped to a fixed duration."""
    r = ranges(spark, folder)
    shift, top = F.lit(900_000_000_000_000), F.lit(1_000_000_000_000_000)
    lo, hi = B.ordered_range(F.col("end_ns") - shift, F.col("start_ns") - shift, top)
    return r.select("range_id", lo.alias("lo"), hi.alias("hi"))


RAW_FRAMES = """
rf AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS media_id, CASE WHEN event_id % 3 = 0 THEN event_id * 40 END AS best,
         CASE WHEN event_id % 2 = 0 THEN event_id * 40 + 1 END AS pts, event_id * 40 + 2 AS dts, event_id % 5 - 1 AS dur,
         event_id % 9 AS ptype, CASE WHEN event_id % 4 = 0 THEN 'unspecified' ELSE event_type END AS rng,
         event_id % 3 * 5 AS depth FROM events)"""


@query(
    "frame_metadata",
    with_(RAW_FRAMES)
    + """SELECT event_id, COALESCE(best, pts, dts) * 1000000 AS pt_ns, COALESCE(pts, best, -1) AS pts,
      CASE WHEN dur > 0 THEN dur * 1000000 ELSE 0 END AS duration_ns, CASE WHEN rng = 'unspecified' THEN 'tv' ELSE rng END AS color_range,
      CASE WHEN depth > 0 THEN depth ELSE 8 END AS bit_depth,
      CASE ptype WHEN 0 THEN 'None' WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'B' WHEN 4 THEN 'S' WHEN 5 THEN 'SI' WHEN 6 THEN 'SP' WHEN 7 THEN 'BI' ELSE 'Unknown' END AS picture_type
    FROM rf""",
)
def frame_metadata(spark, folder):
    e = A.load(spark, folder, "events")
    k = F.col("event_id")
    null = F.lit(None)
    color = F.struct(
        F.when(k % 4 == 0, "unspecified").otherwise(F.col("event_type")).alias("range"), F.lit("bt709").alias("matrix"),
        F.lit("bt709").alias("primaries"), F.lit("bt709").alias("transfer"),
    )
    raw = e.select(
        F.col("user_id").cast("string").alias("media_id"), k.alias("presentation_index"),
        F.when(k % 2 == 0, k * 40 + 1).alias("pts"), (k * 40 + 2).alias("dts"), F.when(k % 3 == 0, k * 40).alias("best_effort_pts"),
        null.cast("bigint").alias("pt_ns"), (k % 5 - 1).alias("duration_ns"), M.picture_type_name(k % 9).alias("picture_type"),
        color.alias("color"), (k % 3 * 5).cast("int").alias("bit_depth"),
    )
    stream_color = F.struct(*[F.lit(v).alias(f) for f, v in zip(M.COLOR_FIELDS, ("tv", "bt709", "bt709", "bt709"))])
    media = raw.select("media_id").distinct().select(
        "media_id", _tb(F.lit(1), F.lit(1000)).alias("time_base"), F.lit(0).cast("bigint").alias("stream_start_pts"),
        stream_color.alias("color"), F.lit(8).alias("bit_depth"),
    )
    out = IO.resolve_frames(raw, IO.valid_media(media))
    return out.select(
        F.col("presentation_index").alias("event_id"), "pt_ns", known("pts").alias("pts"), "duration_ns",
        F.col("color.range").alias("color_range"), F.col("bit_depth").cast("bigint").alias("bit_depth"), "picture_type",
    )


@query(
    "hdr_metadata",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 7 <> 0 THEN ROUND(event_id % 50000 / 50000.0::DOUBLE, 6) ELSE -1 END AS red_x,
      CASE WHEN event_id % 3 <> 0 THEN ROUND(event_id % 100 / 10000.0::DOUBLE, 6) ELSE -1 END AS luminance_min,
      CASE WHEN (event_id % 4 = 0 OR event_id % 7 = 0) AND event_id % 3 = 0 THEN 1 ELSE 0 END AS absent,
      CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 1000 END AS max_cll FROM events""",
)
def hdr_metadata(spark, folder):
    """Primaries flagged off for some frames and with a zero denominator for others."""
    k = F.col("event_id")
    point = lambda den: F.struct(_tb(k % 50000, den).alias("x"), _tb(k % 40000, F.lit(50000)).alias("y"))
    fine, off = F.lit(50000), F.when(k % 7 == 0, 0).otherwise(50000)
    raw = F.struct(
        (k % 4 != 0).alias("has_primaries"), (k % 3 != 0).alias("has_luminance"),
        F.struct(point(fine).alias("red"), point(fine).alias("green"), point(off).alias("blue"), point(fine).alias("white")).alias("primaries"),
        F.struct(_tb(k % 100, F.lit(10000)).alias("min"), _tb(F.lit(1000), F.lit(1)).alias("max")).alias("luminance"),
    )
    e = A.load(spark, folder, "events").select("event_id", raw.alias("raw"))
    out = e.withColumn("m", M.mastering_display(F.col("raw"))).withColumn(
        "light", M.content_light(F.when(k % 5 != 0, k % 1000), k % 400)
    )
    missing = lambda c: F.coalesce(F.round(c, 6), F.lit(-1.0))
    return out.select(
        "event_id", missing(F.col("m.primaries.red.x")).alias("red_x"), missing(F.col("m.luminance.min")).alias("luminance_min"),
        F.col("m").isNull().cast("bigint").alias("absent"), known("light.max_cll").alias("max_cll"),
    )


@query(
    "media_fingerprint",
    """SELECT o_orderkey, sha256(LENGTH(p) || ':' || p || '|' || LENGTH(s) || ':' || s || '|' || LENGTH(m) || ':' || m || '|' || '1:0|1:2|1:2|') AS fingerprint
    FROM (SELECT o_orderkey, '/media/' || o_orderkey || '.mp4' AS p, CAST(o_custkey AS VARCHAR) AS s, CAST(o_orderkey * 1000 AS VARCHAR) AS m FROM orders)""",
)
def media_fingerprint(spark, folder):
    o = A.load(spark, folder, "orders")
    path = F.concat(F.lit("/media/"), F.col("o_orderkey"), F.lit(".mp4"))
    return o.select("o_orderkey", M.media_fingerprint(path, F.col("o_custkey"), F.col("o_orderkey") * 1000, F.lit(0)).alias("fingerprint"))


@query(
    "hash_distances",
    with_(EVENTS)
    + """SELECT a.media_id, a.presentation_index, bit_count(xor(a.content_hash, b.content_hash)) AS hamming,
      ROUND(1 - bit_count(xor(a.content_hash, b.content_hash)) / 64.0::DOUBLE, 6) AS similarity,
      ROUND(0.2126::DOUBLE * (a.content_hash % 256) + 0.7152::DOUBLE * (b.content_hash % 256) + 0.0722::DOUBLE * 7, 4) AS luma
    FROM samples a JOIN samples b ON b.media_id = a.media_id AND b.presentation_index = a.presentation_index + 1""",
)
def hash_distances(spark, folder):
    s = samples(spark, folder).plain().select("media_id", "presentation_index", "content_hash")
    n = s.select("media_id", (F.col("presentation_index") - 1).alias("presentation_index"), F.col("content_hash").alias("other"))
    a, b = F.col("content_hash"), F.col("other")
    return s.join(n, ["media_id", "presentation_index"]).select(
        "media_id", "presentation_index", S.hamming(a, b).cast("bigint").alias("hamming"),
        dbl(S.hash_similarity(a, b)).alias("similarity"), F.round(S.luma(a % 256, b % 256, F.lit(7)), 4).alias("luma"),
    )


@query(
    "high_motion",
    with_(EVENTS) + "SELECT media_id, presentation_index FROM samples WHERE motion >= CAST(0.2 AS FLOAT) AND key_frame",
)
def high_motion(spark, folder):
    return samples(spark, folder).df.where(S.high_motion(F.col("motion"), 0.2) & F.col("key_frame")).select("media_id", "presentation_index")


UPSERT = """
stored AS (SELECT media_id, presentation_index, pt_ns, pts, motion, pts AS ingest_seq FROM samples WHERE event_type <> 'view'),
changes AS (SELECT media_id, presentation_index - presentation_index % 3 AS presentation_index, pt_ns + 1 AS pt_ns, pts, motion,
            pts + 10000000 AS ingest_seq FROM samples WHERE event_type IN ('view', 'click'))"""


@query(
    "sample_upsert",
    with_(EVENTS, UPSERT)
    + """SELECT media_id, presentation_index, pt_ns, ROUND(CAST(motion AS DOUBLE), 6) AS motion FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id, presentation_index ORDER BY ingest_seq DESC) AS r
      FROM (SELECT * FROM stored UNION ALL SELECT * FROM changes)) WHERE r = 1""",
)
def sample_upsert(spark, folder):
    s = samples(spark, folder).plain().select("media_id", "presentation_index", "pt_ns", "pts", "motion", "ingest_seq", "event_type")
    stored = s.where("event_type <> 'view'").drop("event_type")
    changes = s.where("event_type in ('view', 'click')").drop("event_type").withColumns(
        {
            "presentation_index": F.col("presentation_index") - F.col("presentation_index") % 3,
            "pt_ns": F.col("pt_ns") + 1, "ingest_seq": F.col("ingest_seq") + 10_000_000,
        }
    )
    return U.upsert_samples(stored, changes).select("media_id", "presentation_index", "pt_ns", dbl("motion").alias("motion"))


@query(
    "sample_replace",
    with_(EVENTS)
    + """SELECT media_id, idx AS presentation_index, MIN(pt_ns) AS pt_ns FROM (SELECT *, presentation_index // 2 AS idx FROM samples) GROUP BY 1, 2""",
)
def sample_replace(spark, folder):
    s = samples(spark, folder).plain().select("media_id", "presentation_index", "pt_ns", "pts")
    doubled = s.withColumn("presentation_index", F.call_function("div", F.col("presentation_index"), F.lit(2)))
    return U.replace_samples(doubled).select("media_id", "presentation_index", "pt_ns")


@query(
    "sample_validation",
    with_(EVENTS)
    + """SELECT media_id, COUNT(*) AS rows, CASE WHEN MAX(bad) = 1 THEN 'rejected' ELSE 'accepted' END AS state
    FROM (SELECT *, CASE WHEN motion * CAST(2.5 AS FLOAT) > CAST(1 AS FLOAT) THEN 1 ELSE 0 END AS bad FROM samples) GROUP BY 1""",
)
def sample_validation(spark, folder):
    """Motion stretched by 2.5: media with a score above 1 are rejected whole."""
    s = samples(spark, folder).plain()
    s = s.withColumn("motion", (F.col("motion") * F.lit(2.5).cast("float")).cast("float"))
    good, bad = U.split_valid(s)
    tag = lambda d, t: d.groupBy("media_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("state", F.lit(t))
    return tag(good, "accepted").unionByName(tag(bad, "rejected"))


@query(
    "boundary_upsert",
    with_(EVENTS)
    + """SELECT media_id, presentation_index, MAX_BY(pt_ns, seq) AS pt_ns FROM (
      SELECT s.media_id, presentation_index, pt_ns, pts AS seq FROM samples s
      UNION ALL SELECT s.media_id, presentation_index, pt_ns - 500000000000, pts + 10000000 FROM samples s JOIN media m USING (media_id)
        WHERE event_type = 'error' AND m.duration_ns > 0 AND pt_ns >= 500000000000) GROUP BY 1, 2""",
)
def boundary_upsert(spark, folder):
    """Error frames move 500 s earlier where that stays inside the media."""
    s = samples(spark, folder)
    cols = ["media_id", "presentation_index", "pts", "serial", "pt_ns", "duration_ns", "key_frame", "ingest_seq"]
    stored = s.plain().select(*cols)
    moved = s.plain().where("event_type = 'error'").select(*cols).withColumns(
        {"pt_ns": F.col("pt_ns") - 500 * SECOND, "ingest_seq": F.col("ingest_seq") + 10_000_000}
    )
    return U.upsert_boundaries(stored, moved, A.media_from_samples(s)).select("media_id", "presentation_index", "pt_ns")


CHAPTERS = """
ch AS (
  SELECT media_id, number, start_ns, CASE WHEN number % 2 = 0 THEN duration_ns ELSE LEAST((start_ns // 1000000 + 90000) * 1000000, duration_ns) END AS end_ns,
         CASE WHEN number = 3 THEN 'Finale' ELSE 'Chapter ' || number END AS title
  FROM (SELECT media_id, duration_ns, i AS number, LEAST((i - 1) * (duration_ns // 3000000) * 1000000, duration_ns) AS start_ns FROM media, generate_series(1, 3) AS g(i)))"""


def _chapters(s):
    """Three chapters per media, a third of it each, in 1/1000 s and given out of order."""
    media = A.media_from_samples(s)
    third = F.call_function("div", F.col("duration_ns"), F.lit(3_000_000))
    one = lambda i, title, end: F.struct(
        F.lit(i).cast("bigint").alias("id"), ((i - 1) * third).cast("bigint").alias("start"),
        ((i - 1) * third + 90_000 if end else F.lit(None)).cast("bigint").alias("end"),
        F.lit(title).cast("string").alias("title"), _tb(F.lit(1), F.lit(1000)).alias("time_base"),
    )
    raw = media.select(
        "media_id", "duration_ns", _tb(F.lit(1), F.lit(1000)).alias("time_base"), F.lit(0).cast("bigint").alias("stream_start_pts"),
        F.array(one(3, "Finale", True), one(1, None, True), one(2, "", False)).alias("raw_chapters"),
    )
    return K.normalise_chapters(raw)


@query("chapters", with_(EVENTS, CHAPTERS) + "SELECT media_id, number, start_ns, GREATEST(end_ns, start_ns) AS end_ns, title FROM ch")
def chapters(spark, folder):
    c = _chapters(samples(spark, folder))
    return c.select("media_id", F.col("number").cast("bigint").alias("number"), "start_ns", "end_ns", "title")


@query(
    "marker_union",
    _recursive(
        EVENTS, SCENES, CHAPTERS,
        """bm AS (SELECT media_id, pts AS marker_id, pt_ns AS time_ns, 'bookmark' AS kind, 'Mark ' || pts AS label FROM samples WHERE event_type = 'purchase'),
        top AS (SELECT media_id, MAX(marker_id) AS t FROM bm GROUP BY 1),
        nch AS (SELECT media_id, COUNT(*) AS c FROM ch GROUP BY 1),
        sn AS (SELECT media_id, start_ns, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY start_ns, frame) AS n FROM scenes)""",
    )
    + """SELECT media_id, marker_id, time_ns, kind, label FROM bm
    UNION ALL SELECT ch.media_id, COALESCE(t, 0) + number, start_ns, 'chapter', title FROM ch LEFT JOIN top USING (media_id)
    UNION ALL SELECT sn.media_id, COALESCE(t, 0) + COALESCE(c, 0) + n, start_ns, 'scene', 'Scene ' || n
      FROM sn LEFT JOIN top USING (media_id) LEFT JOIN nch USING (media_id)""",
)
def marker_union(spark, folder):
    from ..operators import detect as D

    s = samples(spark, folder)
    marks = s.plain().where("event_type = 'purchase'").select(
        "media_id", F.col("pts").alias("marker_id"), F.col("pt_ns").alias("time_ns"), F.lit("bookmark").alias("kind"),
        F.concat(F.lit("Mark "), F.col("pts")).alias("label"), F.lit("").alias("category"), F.lit("").alias("note"),
    )
    found = D.scenes(D.prepare(s), DETECT)
    return K.all_markers(marks, _chapters(s), found).select("media_id", "marker_id", "time_ns", "kind", "label")


@query(
    "marker_changes",
    with_(EVENTS, """
    edits AS (SELECT media_id, presentation_index // 4 AS marker_id, presentation_index AS seq, presentation_index % 4 AS step, pt_ns + 99000000000000 AS t,
        event_type, presentation_index FROM samples),
    lastc AS (SELECT media_id, MAX(presentation_index // 8) * 4 AS cleared FROM samples GROUP BY 1)""")
    + """SELECT e.media_id, e.marker_id, LEAST(MAX_BY(t, seq), ANY_VALUE(duration_ns)) AS time_ns, MAX_BY(event_type, seq) AS kind
    FROM edits e JOIN media USING (media_id) JOIN lastc USING (media_id)
    WHERE step < 3 AND e.seq < cleared * 2 + 1000000
    GROUP BY 1, 2 HAVING COUNT(CASE WHEN step = 0 THEN 1 END) = 1
      AND MAX(CASE WHEN marker_id % 5 = 0 THEN 1 ELSE 0 END) = 0
      AND NOT (MAX(seq) < ANY_VALUE(cleared) AND MAX_BY(event_type, seq) = 'error')""",
)
def marker_changes(spark, folder):
    """Groups of four frames: add, two updates, then a removal of every fifth marker. Error
    markers that existed half way are cleared there."""
    s = samples(spark, folder).plain()
    i = F.col("presentation_index")
    marker = F.call_function("div", i, F.lit(4))
    step = i % 4
    base = [
        "media_id", marker.alias("marker_id"), (F.col("pt_ns") + 99_000 * SECOND).alias("time_ns"), F.col("event_type").alias("kind"),
        F.lit("").alias("label"), F.lit("").alias("category"), F.lit("").alias("note"),
    ]
    seq = (i * 10).alias("change_seq")
    edits = s.where(step < 3).select(*base, seq, F.when(step == 0, "add").otherwise("update").alias("op"))
    removed = s.where((marker % 5 == 0) & (step == 0)).select(*base, (i * 10 + 35).alias("change_seq"), F.lit("remove").alias("op"))
    half = s.groupBy("media_id").agg((F.max(F.call_function("div", i, F.lit(8))) * 4).alias("h"))
    null = F.lit(None)
    clears = half.select(
        "media_id", null.cast("bigint").alias("marker_id"), null.cast("bigint").alias("time_ns"), F.lit("error").alias("kind"),
        F.lit("").alias("label"), F.lit("").alias("category"), F.lit("").alias("note"),
        (F.col("h") * 10 - 1).alias("change_seq"), F.lit("clear").alias("op"),
    )
    out = K.apply_marker_changes(edits.unionByName(removed).unionByName(clears), A.media_from_samples(s))
    return out.select("media_id", "marker_id", "time_ns", "kind")


@query(
    "distinct_targets",
    with_(EVENTS, RANGES) + "SELECT DISTINCT media_id, LEAST(start_ns, duration_ns) AS time_ns FROM ranges JOIN media USING (media_id)",
)
def distinct_targets(spark, folder):
    r = ranges(spark, folder).select("media_id", F.col("start_ns").alias("time_ns"))
    return K.distinct_targets(r, A.media_from_samples(samples(spark, folder)))


@query(
    "seek_percentiles",
    """SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""",
)
def seek_percentiles(spark, folder):
    e = A.load(spark, folder, "events")
    return T.nearest_rank(e, ["event_type"], "value", {"median": 0.5, "p95": 0.95})


@query(
    "telemetry_summary",
    """SELECT CAST(user_id AS VARCHAR) AS session_id,
      ROUND(CASE WHEN h + m > 0 THEN h * 100.0::DOUBLE / (h + m) ELSE 0 END, 6) AS hit_percent, e AS evictions, d AS delivered, 0.0::DOUBLE AS dropped,
      ROUND(COALESCE(l, -1), 6) AS last_seek
    FROM (SELECT user_id, CAST(COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS DOUBLE) AS h, CAST(COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS DOUBLE) AS m,
      CAST(COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) AS e, CAST(COUNT(CASE WHEN event_type = 'signup' THEN 1 END) AS DOUBLE) AS d,
      MAX_BY(value, event_id) FILTER (WHERE event_type = 'purchase') AS l FROM events GROUP BY 1)""",
)
def telemetry_summary(spark, folder):
    out = T.telemetry_summary(A.telemetry_from_events(A.load(spark, folder, "events")))
    return out.select(
        "session_id", dbl("hit_percent").alias("hit_percent"), "evictions", "delivered", "dropped",
        F.round(F.coalesce("last_seek", F.lit(-1.0)), 6).alias("last_seek"),
    )


@query(
    "latest_request",
    "SELECT CAST(user_id AS VARCHAR) AS session_id, MAX(event_id) AS generation, MAX_BY(value, event_id) AS value FROM events GROUP BY 1",
)
def latest_request(spark, folder):
    e = A.load(spark, folder, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("generation"), "value")
    return T.latest_request(e, ["session_id"]).select("session_id", "generation", "value")


@query(
    "ewma",
    """WITH RECURSIVE r AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value > 0),
    w AS (SELECT user_id, n, 1 / value AS rate FROM r WHERE n = 1
      UNION ALL SELECT r.user_id, r.n, w.rate * 0.85::DOUBLE + 1 / r.value * 0.15::DOUBLE FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS session_id, MAX(n) AS observations, ROUND(MAX_BY(rate, n), 6) AS rate FROM w GROUP BY 1""",
)
def ewma(spark, folder):
    log = A.load(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("value").alias("seconds")
    )
    return T.decode_rate(log).select("session_id", "observations", dbl("rate").alias("rate"))


def _visits(spark, folder):
    return A.load(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("seq"), F.lit("m").alias("media_id"),
        F.floor(F.col("value") / 40).cast("bigint").alias("presentation_index"), F.col("event_id").alias("pts"),
        F.lit(0).cast("bigint").alias("serial"), F.col("event_id").alias("pt_ns"),
    )


@query(
    "recent_visits",
    """WITH v AS (SELECT user_id, event_id, CAST(floor(value / 40) AS BIGINT) AS f FROM events),
    n AS (SELECT *, LEAD(f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM v)
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS seq, f AS presentation_index, recency FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS recency FROM n WHERE g IS NULL OR f <> g) WHERE recency <= 16""",
)
def recent_visits(spark, folder):
    return T.recent_visits(_visits(spark, folder), 16).select("user_id", "seq", "presentation_index", "recency")


def _catalogue(s):
    return A.media_from_samples(s).select(
        "media_id", F.concat(F.lit("/media/"), F.col("media_id")).alias("path"), F.lit(100).cast("bigint").alias("file_size"),
        F.lit(5).cast("bigint").alias("mtime_ms"), F.lit(0).alias("stream_index"),
    )


@query(
    "stored_samples",
    with_(EVENTS)
    + """SELECT media_id, COUNT(*) AS rows, MAX(pt_ns) AS last_ns FROM samples WHERE CAST(media_id AS BIGINT) % 3 <> 0 GROUP BY 1""",
)
def stored_samples(spark, folder):
    """A partial run, the complete one, and that again; every third media changed on disk since, so it is not visible."""
    s = samples(spark, folder)
    media = _catalogue(s)
    path = scratch(spark, "samples")
    IO.write_samples(s.plain().where("presentation_index % 2 = 0"), media, path, complete=False)
    for _ in range(2):
        IO.write_samples(s.plain(), media, path)
    changed = media.withColumn("file_size", F.when(F.col("media_id").cast("bigint") % 3 == 0, 107).otherwise(100).cast("bigint"))
    return IO.read_samples(spark, changed, path, complete_only=True).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("pt_ns").alias("last_ns")
    )


@query("pending_media", with_(EVENTS) + "SELECT media_id FROM media WHERE CAST(media_id AS BIGINT) % 3 = 0 OR CAST(media_id AS BIGINT) % 4 = 0")
def pending_media(spark, folder):
    """Complete documents exist for media not divisible by 4; those divisible by 3 changed since."""
    media = _catalogue(samples(spark, folder))
    k = F.col("media_id").cast("bigint")
    status = IO.with_fingerprint(media).select(
        "media_id", "fingerprint", F.lit(2).alias("schema_version"), F.lit(2).alias("algo_version"), (k % 4 != 0).alias("complete")
    )
    changed = media.withColumn("mtime_ms", F.when(k % 3 == 0, 6).otherwise(5).cast("bigint"))
    return IO.pending_media(changed, status).select("media_id")


@query(
    "stored_detections",
    with_(EVENTS)
    + """SELECT media_id, CASE WHEN key_frame THEN 'freeze' ELSE 'scene' END AS kind,
      COUNT(*) + CASE WHEN key_frame THEN 0 ELSE 1000 END AS n FROM samples GROUP BY media_id, key_frame""",
)
def stored_detections(spark, folder):
    """Results written twice by kind; the second write, at other times, replaces only its own kind."""
    s = samples(spark, folder)
    rows = s.plain().select(
        "media_id", F.col("pt_ns").alias("start_ns"), F.when(F.col("key_frame"), "freeze").otherwise("scene").alias("kind")
    )
    path = scratch(spark, "detections")
    IO.write_results(rows, path, order=("start_ns",))
    IO.write_results(rows.where("kind = 'freeze'").withColumn("start_ns", F.lit(-1).cast("bigint")), path, order=("start_ns",))
    kept = F.when(F.min("start_ns") >= 0, 1000).otherwise(0)
    return IO.read_results(spark, path).groupBy("media_id", "kind").agg((F.count(F.lit(1)) + kept).alias("n"))


@query(
    "stored_media",
    "SELECT CAST(user_id AS VARCHAR) AS media_id, COUNT(*) AS declared_frames FROM events WHERE user_id % 5 <> 0 GROUP BY 1",
)
def stored_media(spark, folder):
    """A stored catalogue read back; every fifth media has no usable time base."""
    counts = samples(spark, folder).plain().groupBy("media_id").agg(F.count(F.lit(1)).alias("declared_frames"))
    base = F.struct(F.lit(1).alias("num"), F.when(F.col("media_id").cast("bigint") % 5 == 0, 0).otherwise(1000).cast("int").alias("den"))
    given = {"declared_frames": F.col("declared_frames"), "media_id": F.col("media_id"), "time_base": base}
    schema = spark.createDataFrame([], SCHEMAS["media"]).schema
    path = scratch(spark, "media")
    counts.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    return IO.read_media(spark, path).select("media_id", "declared_frames")


@query("stored_planes", "SELECT CAST(label AS VARCHAR) AS media_id, COUNT(*) AS planes FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY 1")
def stored_planes(spark, folder):
    """Planes written and read back; every tenth is cut short, and so not valid."""
    e = A.load(spark, folder, "embeddings")
    rows = e.select(
        F.col("label").cast("string").alias("media_id"), F.col("vec_id").alias("presentation_index"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("channels"), F.expr("cast(repeat('p', IF(vec_id % 10 = 0, 63, 64)) AS binary)").alias("data"),
    )
    path = scratch(spark, "planes")
    IO.write_planes(rows, path)
    return IO.read_planes(spark, path).groupBy("media_id").agg(F.count(F.lit(1)).alias("planes"))


@query("presentation_order", with_(EVENTS) + "SELECT media_id, presentation_index, pts FROM samples")
def presentation_order(spark, folder):
    from ..operators.order import sequence

    o = sequence(samples(spark, folder), names=("position", "", ""))
    return o.df.select("media_id", F.col("position").alias("presentation_index"), "pts")
