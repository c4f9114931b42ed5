"""The given tables as engine tables: events as samples and frames, embeddings as planes and
hashes, orders as probes, line items as ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import FRAME_ORDER, SECOND
from .operators.order import Ordered, arrange, sequence, settle

# Probe and range times: one day of an order date is this many seconds of media time.
DAY_NS = 1000 * SECOND


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")


def samples_from_events(events: DataFrame) -> Ordered:
    """One media per user, one sample per event; scores follow from the event value."""
    raw = events.select(
        F.col("user_id").cast("string").alias("media_id"),
        "event_id",
        _micros(F.col("ts")).alias("us"),
        "event_type",
        "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
    )
    o = sequence(arrange(raw, ("media_id",), ("us", "event_id")), ["us"], next=True)
    if o.split:
        origin = raw.groupBy("media_id").agg(F.min("us").alias("us0"))
        df = o.df.join(origin, "media_id")
    else:
        df = o.df.withColumn("us0", F.first("us").over(o.window().rowsBetween(Window.unboundedPreceding, 0)))
    level = F.least(F.col("value") / 500, F.lit(1.0))
    out = df.select(
        *o.part,
        F.col("_pos").alias("presentation_index"),
        F.col("event_id").alias("pts"),
        ((F.col("us") - F.col("us0")) * 1000).alias("pt_ns"),
        (F.coalesce(F.col("_next.us") - F.col("us"), F.lit(0)) * 1000).alias("duration_ns"),
        (F.col("event_type") == "signup").alias("key_frame"),
        level.cast("float").alias("motion"),
        (1 - level / 2).cast("float").alias("similarity"),
        level.cast("float").alias("scene_score"),
        F.when(F.col("_pos") > 0, F.greatest(F.lit(0.0), 1 - level).cast("float")).alias("duplicate_score"),
        F.floor("value").cast("bigint").alias("content_hash"),
        F.call_function("div", F.col("k"), F.lit(25)).alias("perceptual_hash"),
        F.lit(1).cast("bigint").alias("serial"),
        F.col("event_id").alias("ingest_seq"),
        "event_type",
    )
    return settle(Ordered(out, ("media_id",), FRAME_ORDER, o.split))


def media_from_samples(samples: DataFrame | Ordered) -> DataFrame:
    rows = samples.df if isinstance(samples, Ordered) else samples
    return rows.groupBy("media_id").agg(
        F.max("pt_ns").alias("duration_ns"), F.count(F.lit(1)).alias("declared_frames")
    ).withColumn("estimated", F.col("declared_frames"))


def media_count(events: DataFrame) -> Column:
    """Users number their media from 0; counted where it is used."""
    return events.select(F.max("user_id") + 1).scalar()


def probes_from_orders(orders: DataFrame, media: Column) -> DataFrame:
    """Probes over all media, by customer."""
    return orders.select(
        (F.col("o_custkey") % media).cast("string").alias("media_id"),
        F.col("o_orderkey").alias("probe_id"),
        (_day(F.col("o_orderdate")) * DAY_NS).alias("target_ns"),
        (F.col("o_orderkey") % 97).alias("index_hint"),
        (F.col("o_orderkey") % 7 * 7200 * SECOND).alias("tolerance_ns"),
    )


def ranges_from_lineitem(lineitem: DataFrame, media: Column) -> DataFrame:
    start = _day(F.col("l_shipdate")) * DAY_NS
    return (
        lineitem.select(
            (F.col("l_orderkey") % media).cast("string").alias("media_id"),
            start.alias("start_ns"),
            (start + F.col("l_quantity").cast("bigint") * 1800 * SECOND).alias("end_ns"),
        )
        .distinct()
        .withColumn("range_id", F.concat_ws(":", "media_id", "start_ns", "end_ns"))
    )


def _level(x: Column) -> Column:
    scaled = (x.cast("double") + 0.6) / 1.2
    return F.floor(F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def _bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(_level(x)), 2, F.lit("0"))), ""))


def _indexed(embeddings: DataFrame) -> Ordered:
    slim = embeddings.select(F.col("label").cast("string").alias("media_id"), "vec_id", "embedding")
    return sequence(arrange(slim, ("media_id",), ("vec_id",)), names=("presentation_index", "", ""))


def planes_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """8x8 gray planes, one media per label."""
    return _indexed(embeddings).plain().select(
        "media_id", "presentation_index", F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("channels"), _bytes(F.col("embedding")).alias("data"),
    )


def color_planes_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """7x3 RGB planes of the first 63 values."""
    return _indexed(embeddings).plain().select(
        "media_id", "presentation_index", F.lit(7).alias("width"), F.lit(3).alias("height"),
        F.lit(3).alias("channels"), _bytes(F.slice("embedding", 1, 63)).alias("data"),
    )


def hashes_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Sign bits as 64-bit patterns, 40 ms per frame."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    bits = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return _indexed(embeddings).plain().select(
        "media_id", "vec_id", "presentation_index", F.col("presentation_index").alias("pts"),
        (F.col("presentation_index") * 40_000_000).alias("pt_ns"), bits.alias("perceptual_hash"),
    )


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Event types as observations of a session per user."""
    # Event type -> metric.
    metric = F.create_map(
        *[F.lit(x) for p in {
            "view": "hit", "click": "miss", "error": "eviction", "signup": "delivered", "purchase": "seek"
        }.items() for x in p]
    )
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.try_element_at(metric, F.col("event_type")).alias("metric"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(1.0)).alias("value"),
        F.col("event_id").alias("generation"),
    )
