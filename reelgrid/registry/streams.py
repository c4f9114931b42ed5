"""Streaming jobs over arrivals derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import detect as D
from ..schemas import SCHEMAS
from ..session import materialise, scratch
from ..sources.tables import stream_samples
from ..streaming import progressive as P
from ..streaming import stateful as S
from ..streaming.replay import latest, replay
from .base import DETECT, EVENTS, GEOMETRY, dbl, known, query, samples, with_
from .detections import COLUMNS, RUNS, SCENE_ROWS, SCENES, _recursive
from .lod import geometry

COLUMNS_IN = [
    "media_id", "presentation_index", "pts", "pt_ns", "duration_ns", "key_frame", "motion", "similarity", "scene_score",
    "duplicate_score", "content_hash", "perceptual_hash", "ingest_seq",
]


def _arrivals(s, parts=3):
    """Samples in ``parts`` arrivals, each media's frames in order."""
    rows = materialise(s.df.select(*COLUMNS_IN))
    last = rows.groupBy("media_id").agg(F.max("presentation_index").alias("_n"))
    slot = F.call_function("div", F.col("presentation_index") * parts, F.col("_n") + 1)
    placed = materialise(rows.join(last, "media_id").withColumn("_slot", slot).drop("_n"))
    return [placed.where(F.col("_slot") == k).drop("_slot") for k in range(parts)]


HOUR_MS = 3_600_000
IDLE_MS = 24 * HOUR_MS


def _arriving(parts, media=None):
    """The arrivals an hour apart, and at last, much later, one row of no media or one that is not known."""
    at = lambda hours: F.timestamp_millis(F.lit(946_684_800_000 + hours * HOUR_MS))
    absent = {f.name: F.lit(None).cast(f.dataType) for f in parts[0].schema if f.name != "media_id"}
    spark = parts[0].sparkSession
    later = spark.range(1).select(F.lit(media).cast("string").alias("media_id"), *[c.alias(n) for n, c in absent.items()])
    if media is not None:
        later = later.withColumn("pt_ns", F.lit(0).cast("bigint"))
    stamped = [p.withColumn("arrived", at(k)) for k, p in enumerate(parts)]
    return [*stamped, later.select(*parts[0].columns).withColumn("arrived", at(10_000))]


def _shuffled(s, parts=3):
    """Arrivals in which a frame may come before up to eight earlier ones, in the next arrival too; and how far that is in time."""
    rows = materialise(s.df.select(*COLUMNS_IN))
    last = rows.groupBy("media_id").agg(F.max("presentation_index").alias("_n"))
    moved = F.col("presentation_index") + F.col("presentation_index") * 7919 % 8
    slot = F.call_function("div", moved * parts, F.col("_n") + 9)
    placed = materialise(rows.join(last, "media_id").withColumn("_slot", slot).drop("_n"))
    earlier = placed.select("media_id", F.col("presentation_index").alias("_i"), F.col("pt_ns").alias("_t"))
    apart = (F.col("_i") < F.col("presentation_index")) & (F.col("_i") >= F.col("presentation_index") - 8)
    delay = placed.join(earlier, "media_id").where(apart).agg(F.max(F.col("pt_ns") - F.col("_t"))).first()[0] or 0
    return [placed.where(F.col("_slot") == k).drop("_slot") for k in range(parts)], delay


def _detections(rows):
    return rows.select(
        "media_id", "kind", "start_ns", "end_ns", known("first_frame").alias("first_frame"), known("last_frame").alias("last_frame"),
        "frame_count", dbl("score", 5).alias("score"),
    )


def _detected(s, kind):
    parts, delay = _shuffled(s)
    detector = kind(DETECT, delay, IDLE_MS, by_arrival=True)
    out = replay(_arriving(parts), lambda rows: S.detect_stream(rows, detector, "arrived"))
    return _detections(out)


@query("stream_runs", with_(EVENTS, RUNS) + f"SELECT {COLUMNS} FROM (SELECT * FROM dups UNION ALL SELECT * FROM frz)")
def stream_runs(spark, folder):
    """Frames out of order within the detector's delay; media end by their timers."""
    return _detected(samples(spark, folder), S.RunDetector)


@query("stream_scenes", _recursive(EVENTS, SCENES) + f"SELECT {COLUMNS} FROM ({SCENE_ROWS})")
def stream_scenes(spark, folder):
    return _detected(samples(spark, folder), S.SceneDetector)


@query(
    "stream_dedup",
    with_(EVENTS)
    + """SELECT media_id, CASE WHEN pts % 3 = 0 AND pts % 5 <> 0 THEN -1 ELSE presentation_index END AS presentation_index, pts, pt_ns,
      ROUND(CAST(motion AS DOUBLE), 6) AS motion FROM samples""",
)
def stream_dedup(spark, folder):
    """Every arrival is delivered again with the next one, and half of the media come after the others.

    A third of the samples have no index; of some of these the indexed sample comes as well, before or later.
    """
    s = samples(spark, folder)
    bare = F.col("pts") % 3 == 0
    late = F.col("media_id").cast("bigint") % 2 == 1
    hidden = F.when(bare, None).otherwise(F.col("presentation_index")).alias("presentation_index")
    a, b = [x.select(*[hidden if c == "presentation_index" else F.col(c) for c in x.columns]) for x in _arrivals(s, 2)]
    twins = materialise(s.df.select(*COLUMNS_IN).where(bare & (F.col("pts") % 5 == 0)))
    first, second = [x.where(~late) for x in (a, b)], [x.where(late) for x in (a, b)]
    parts = [
        first[0].unionByName(twins.where("pts % 2 = 0")), first[0].unionByName(first[1]),
        first[1].unionByName(second[0]), second[0].unionByName(second[1]).unionByName(twins.where("pts % 2 = 1")),
    ]
    out = replay(_arriving(parts), lambda rows: P.dedup_stream(rows, "100 hours", IDLE_MS, "arrived"))
    return out.select("media_id", known("presentation_index").alias("presentation_index"), "pts", "pt_ns", dbl("motion").alias("motion"))


@query(
    "stream_lod",
    with_(EVENTS, GEOMETRY)
    + "SELECT media_id, bucket, sample_count, ROUND(motion_sum, 6) AS motion_sum, ROUND(similarity_sum, 6) AS similarity_sum FROM acc WHERE level = 0",
)
def stream_lod(spark, folder):
    s = samples(spark, folder)
    g = materialise(geometry(s))
    out = replay(_arrivals(s), lambda rows: P.progressive_lod(rows, g), "update")
    return latest(out, ["media_id", "bucket"]).select(
        "media_id", "bucket", "sample_count", dbl("motion_sum").alias("motion_sum"), dbl("similarity_sum").alias("similarity_sum")
    )


@query(
    "stream_lod_closed",
    with_(EVENTS, GEOMETRY)
    + """SELECT media_id, bucket, sample_count, ROUND(motion_sum, 6) AS motion_sum, ROUND(CAST(motion_min AS DOUBLE), 6) AS motion_min,
      ROUND(CAST(motion_max AS DOUBLE), 6) AS motion_max, ROUND(similarity_sum, 6) AS similarity_sum FROM acc WHERE level = 0""",
)
def stream_lod_closed(spark, folder):
    """Buckets as they close, at the default delay; half of the media come wholly after the others."""
    s = samples(spark, folder)
    g = materialise(geometry(s))
    late = F.col("media_id").cast("bigint") % 2 == 1
    parts = _arrivals(s, 2)
    parts = [p.where(~late) for p in parts] + [p.where(late) for p in parts]
    out = replay(_arriving(parts, "-"), lambda rows: P.closed_lod(rows, g, idle_ms=IDLE_MS, arrival="arrived"))
    sums = out.groupBy("media_id", "bucket").agg(
        F.sum("sample_count").alias("sample_count"), F.sum("motion_sum").alias("motion_sum"), F.min("motion_min").alias("motion_min"),
        F.max("motion_max").alias("motion_max"), F.sum("similarity_sum").alias("similarity_sum"),
    )
    return sums.select("media_id", "bucket", "sample_count", *[dbl(c).alias(c) for c in ("motion_sum", "motion_min", "motion_max", "similarity_sum")])


@query("stream_progress", with_(EVENTS) + "SELECT media_id, n AS sample_count, 0.5::DOUBLE AS progress FROM media")
def stream_progress(spark, folder):
    """Half of the declared frames exist."""
    s = samples(spark, folder)
    media = materialise(A.media_from_samples(s).withColumn("declared_frames", F.col("declared_frames") * 2))
    out = replay(_arrivals(s), lambda rows: P.progress(rows, media), "update")
    return latest(out, ["media_id"]).select("media_id", "sample_count", dbl("progress").alias("progress"))


@query(
    "stream_ingest",
    with_(EVENTS)
    + """SELECT media_id, presentation_index, pt_ns + CASE WHEN event_type = 'click' THEN 7 ELSE 0 END AS pt_ns FROM samples""",
)
def stream_ingest(spark, folder):
    """Late corrections of click frames arrive last and win."""
    s = samples(spark, folder)
    parts = _arrivals(s)
    late = materialise(s.df.where("event_type = 'click'").select(*COLUMNS_IN).withColumn("pt_ns", F.col("pt_ns") + 7))
    path, state, source = (scratch(spark, n) for n in ("table", "state", "source"))
    for part in [*parts, late]:
        part.write.mode("append").parquet(source)
        stream = P.ingest(spark.readStream.schema(part.schema).parquet(source), path)
        stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return P.merged_samples(spark, path).select("media_id", "presentation_index", "pt_ns")


@query("stream_source", with_(EVENTS) + "SELECT media_id, COUNT(*) AS rows, MAX(pt_ns) AS last_ns FROM samples GROUP BY 1")
def stream_source(spark, folder):
    """Samples read from their folder as they arrive, a few files at a time, and stored by ingest."""
    path, state, source = (scratch(spark, n) for n in ("table", "state", "source"))
    schema = spark.createDataFrame([], SCHEMAS["samples"]).schema
    rows = samples(spark, folder).plain()
    given = [F.col(f.name) if f.name in rows.columns else F.lit(None) for f in schema]
    for part in range(2):
        arrived = rows.where(F.col("presentation_index") % 2 == part)
        arrived.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(given, schema)]).write.mode("append").parquet(source)
        stream = P.ingest(stream_samples(spark, source, 3), path)
        stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return P.merged_samples(spark, path).groupBy("media_id").agg(F.count(F.lit(1)).alias("rows"), F.max("pt_ns").alias("last_ns"))


@query("stream_redetection", _recursive(EVENTS, SCENES) + f"SELECT {COLUMNS} FROM ({SCENE_ROWS})")
def stream_redetection(spark, folder):
    """Scenes of a table that grows in five arrivals, detected again when it has grown enough."""
    s = samples(spark, folder)
    path, state, source, results, counts = (scratch(spark, n) for n in ("table", "state", "source", "results", "counts"))

    def run(rows):
        D.scenes(D.prepare(rows), DETECT).write.mode("overwrite").parquet(results)

    for part in _arrivals(s, 5):
        again = P.Redetection(run, state=counts)  # as after a restart
        part.write.mode("append").parquet(source)
        stream = P.ingest(spark.readStream.schema(part.schema).parquet(source), path, again)
        stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    again.finish(P.merged_samples(spark, path))
    return _detections(spark.read.parquet(results))


def _log(spark, folder):
    """Events in three arrivals by id."""
    e = A.load(spark, folder, "events")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"))
    top = rows.agg(F.max("seq")).first()[0]
    return [rows.where(F.call_function("div", F.col("seq") * 3, F.lit(top + 1)) == k) for k in range(3)]


@query(
    "stream_latest_request",
    "SELECT CAST(user_id AS VARCHAR) AS session_id, MAX(event_id) AS seq, MAX_BY(value, event_id) AS seconds FROM events GROUP BY 1",
)
def stream_latest_request(spark, folder):
    out = replay(_log(spark, folder), lambda s: P.latest_requests(s, ["session_id"], "seq"), "update")
    return latest(out, ["session_id"]).select("session_id", "seq", "seconds")


@query(
    "stream_decode_rate",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value > 0),
    w AS (SELECT user_id, event_id, n, 1 / value AS rate FROM r WHERE n = 1
      UNION ALL SELECT r.user_id, r.event_id, r.n, w.rate * 0.85::DOUBLE + 1 / r.value * 0.15::DOUBLE FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ROUND(rate, 6) AS rate FROM w""",
)
def stream_decode_rate(spark, folder):
    return replay(_log(spark, folder), S.decode_rate_stream).select("session_id", "seq", dbl("rate").alias("rate"))


@query("stream_visits")
def stream_visits(spark, folder):
    """Errors go back, signups go forward, other events visit a frame."""
    e = A.load(spark, folder, "events")
    kind = F.col("event_type")
    rows = e.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "back").when(kind == "signup", "forward").otherwise("visit").alias("action"),
        F.lit(0).cast("bigint").alias("serial"), F.floor(F.col("value") / 40).cast("bigint").alias("presentation_index"),
        F.col("event_id").alias("pts"), F.col("event_id").alias("pt_ns"),
    )
    top = rows.agg(F.max("seq")).first()[0]
    parts = [rows.where(F.call_function("div", F.col("seq") * 2, F.lit(top + 1)) == k) for k in range(2)]
    return replay(parts, lambda s: S.visit_history(s, 16)).drop("batch")
