"""Progressive ingest, LOD, coverage and re-detection on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.lod import SCORES, bucket_of
from ..operators.samples import latest_by_identity
from ..config import SECOND
from ..functions.scores import unit
from .stateful import ClosingBuckets, distinct_identities, stateful

EVENT_TIME = "event_time"
ARRIVAL = "arrival_time"


# Media time 0 as an event time. A watermark starts at the epoch and drops what is not after it.
ORIGIN_US = 946_684_800_000_000


def with_event_time(samples: DataFrame) -> DataFrame:
    """Microsecond event time beside the exact nanoseconds, for watermarks only."""
    micros = F.call_function("div", F.col("pt_ns"), F.lit(1000)) + F.lit(ORIGIN_US)
    return samples.withColumn(EVENT_TIME, F.timestamp_micros(micros))


def dedup_stream(samples: DataFrame, delay: str = "10 minutes", wait_ms: int = 10_000, arrival: str | None = None) -> DataFrame:
    """Samples once per identity; a sample delivered again within ``delay`` of its arrival is dropped.

    Indexed samples are one by index. Samples without one are one by time and stream timestamp, and wait
    ``wait_ms`` for an indexed sample of both, which takes their place. The watermark follows arrival, not media
    time: media progress apart from each other, and one that starts late must not lose its rows to one that
    is far ahead. No row is ever late. ``arrival``: the column that holds it, by default the time of processing.
    """
    known = F.coalesce(F.col("presentation_index") >= 0, F.lit(False))
    timed = samples.withColumn(ARRIVAL, F.current_timestamp() if arrival is None else F.col(arrival)).withWatermark(ARRIVAL, delay)
    if arrival is not None:
        return _distinct_by_arrival(timed.drop(arrival), known, delay, wait_ms)
    # One dropping operator for both kinds: a row without index is told by its own times and timestamp.
    keys = {"_index": F.when(known, F.col("presentation_index")), "_at": F.when(~known, F.col("pt_ns")), "_pts": F.when(~known, F.col("pts"))}
    once = timed.withColumns(keys).dropDuplicatesWithinWatermark(["media_id", *keys])
    return distinct_identities(once.drop(*keys, ARRIVAL), None, None, wait_ms)


# What has been seen with an index is forgotten this long after the clock has passed it.
KEEP_MS = 600_000


def _distinct_by_arrival(timed: DataFrame, known: Column, delay: str, wait_ms: int) -> DataFrame:
    """``dedup_stream`` by an arrival column: drops and waiting are joins and drops of Spark, whose clock is the watermark.

    A row without an index waits in an outer join for an indexed one of its time and stream timestamp, which
    may have come before it too; rows of no media only move the clock on.
    """
    # A condition on the arrival stays above the watermark, which rows of no media must reach.
    when = lambda kind: F.when(F.col(ARRIVAL) > F.timestamp_millis(F.lit(-(10**14))), F.col("media_id").isNotNull() & kind)
    indexed, bare = timed.where(when(known)), timed.where(when(~known))
    passed = indexed.dropDuplicatesWithinWatermark(["media_id", "presentation_index"]).drop(ARRIVAL)
    waiting = bare.dropDuplicatesWithinWatermark(["media_id", "pt_ns", "pts"]).alias("w")
    seen = indexed.select("media_id", "pt_ns", "pts", F.col(ARRIVAL).alias("_seen")).alias("i")
    near = F.expr(f"_seen <= w.{ARRIVAL} + interval {wait_ms} milliseconds and w.{ARRIVAL} <= _seen + interval {delay} + interval {KEEP_MS} milliseconds")
    same = (F.col("w.media_id") == F.col("i.media_id")) & F.col("w.pt_ns").eqNullSafe(F.col("i.pt_ns")) & F.col("w.pts").eqNullSafe(F.col("i.pts"))
    alone = waiting.join(seen, same & near, "left_outer").where("_seen is null")
    return passed.unionByName(alone.select("w.*").drop(ARRIVAL))


def merged_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples ingested so far: the latest batch wins per identity, wherever in time it falls."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return latest_by_identity(rows, [F.col("batch"), F.col("ingest_seq"), F.col("pt_ns"), F.col("pts")]).drop("batch")


def ingest(
    stream: DataFrame, path: str, after: Callable[[DataFrame, int, int], None] | None = None
) -> DataStreamWriter:
    """Append each batch as its own folder; ``after`` sees the merged table then, and the batch's rows.

    Nothing stored is rewritten, late rows are taken like any other, and a batch repeated after a
    failure overwrites its own folder only, so the result stays exactly once.
    """

    def step(rows: DataFrame, batch: int) -> None:
        rows.drop(EVENT_TIME).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if after is not None:
            arrived = rows.sparkSession.read.parquet(f"{path}/batch={batch}").count()
            after(merged_samples(rows.sparkSession, path), batch, arrived)

    return stream.writeStream.foreachBatch(step)


class Redetection:
    """Reruns ``run`` when a table has grown by max(128, 25 %) samples since the last run.

    Growth is counted from each batch's own folder, so the merged table is touched only when a run is
    due. With ``state``, a folder, what has been counted survives a restart, and a batch that is repeated
    after a failure counts once.
    """

    def __init__(self, run: Callable[[DataFrame], None], first: int = 32, state: str | None = None):
        self.run, self.threshold, self.runs, self.state, self.total = run, first, 0, state, 0

    def __call__(self, samples: DataFrame, batch: int = 0, arrived: int | None = None) -> None:
        if self.state is not None:
            self._resume(samples.sparkSession, batch)
        self.total = samples.count() if arrived is None else self.total + arrived
        if self.total >= self.threshold:
            self.run(samples)
            self.runs += 1
            self.threshold = next_detection(self.total)
        if self.state is not None:
            row = samples.sparkSession.createDataFrame([(self.total, self.threshold)], "total long, threshold long")
            row.write.mode("overwrite").parquet(f"{self.state}/batch={batch}")

    def _resume(self, spark: SparkSession, batch: int) -> None:
        """Counts as they stood before this batch."""
        try:
            rows = spark.read.parquet(self.state).where(F.col("batch") < batch)
        except AnalysisException:
            return  # nothing counted yet
        last = rows.orderBy(F.desc("batch")).first()
        if last is not None:
            self.total, self.threshold = last.total, last.threshold

    def finish(self, samples: DataFrame) -> None:
        self.run(samples)
        self.runs += 1


def next_detection(total: int) -> int:
    return total + max(128, total // 4)


def _bucketed(stream: DataFrame, geometry: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    slim = stream.select("media_id", "pt_ns", *more, *SCORES.values())
    bucket = bucket_of(F.col("pt_ns"), F.col("duration_ns"), F.col("span_ns"), F.col("buckets"))
    return slim.join(geometry, "media_id", how).withColumn("bucket", bucket)


def _sums() -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    for name, column in SCORES.items():
        value = F.when(F.col(column).isNotNull(), unit(F.col(column)))
        aggs += [
            F.count(column).alias(f"{name}_count"),
            F.sum(value.cast("double")).alias(f"{name}_sum"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return aggs


def progressive_lod(stream: DataFrame, geometry: DataFrame) -> DataFrame:
    """Base LOD accumulators so far, by media and bucket; update mode. Nothing closes, so no row is late."""
    return _bucketed(stream, geometry).groupBy("media_id", "bucket").agg(*_sums())


CLOSED = "media_id string, bucket bigint, sample_count bigint, " + ", ".join(
    f"{name}_count bigint, {name}_sum double, {name}_min double, {name}_max double" for name in SCORES
) + ", late boolean"


def closed_lod(
    stream: DataFrame, geometry: DataFrame, delay_ns: int = 600 * SECOND, idle_ms: int = 600_000, arrival: str | None = None, arrival_delay: str = "1 minute"
) -> DataFrame:
    """Base LOD accumulators of buckets that are closed; append mode.

    A bucket closes when its media is past its end by ``delay_ns`` of media time, or when no row of the media has
    arrived for ``idle_ms``. Each media has its own mark, so one that starts after others have ended loses
    nothing. Rows for a closed bucket come as one more set of sums, marked late; sums of all sets are the bucket.
    Rows are summed in each partition first, so that a media with most of the rows reaches its state as few.
    """
    ms = F.lit(0).cast("bigint") if arrival is None else F.unix_millis(arrival)
    rows = stream.withColumn("arrived_ms", ms)
    kept = ["arrived_ms", *([arrival] if arrival else [])]
    geometry = geometry.select("media_id", "duration_ns", "span_ns", "buckets")
    # Rows of unknown media move the clock on as rows of none.
    placed = _bucketed(rows, geometry, *kept, how="inner" if arrival is None else "left")
    unknown = F.col("span_ns").isNull()
    known = placed.withColumns({
        "media_id": F.when(~unknown, F.col("media_id")), "bucket": F.when(unknown, F.lit(0)).otherwise(F.col("bucket")),
        "pt_ns": F.when(unknown, F.lit(0)).otherwise(F.col("pt_ns")),
    })
    end = F.when(unknown, F.lit(0)).otherwise(F.least((F.col("bucket") + 1) * F.col("span_ns"), F.col("duration_ns")))
    scores = [F.when(F.col(c).isNotNull(), unit(F.col(c))).cast("double").alias(n) for n, c in SCORES.items()]
    slim = known.select("media_id", "bucket", end.alias("end_ns"), "pt_ns", *kept, *scores)
    names = [c.split()[0] for c in CLOSED.split(", ")][2:-1]
    form = f"media_id string, bucket bigint, end_ns bigint, top_ns bigint, arrived_ms bigint, {', '.join(CLOSED.split(', ')[2:-1])}" + (f", {arrival} timestamp" if arrival else "")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            aggs = {"end_ns": ("end_ns", "max"), "top_ns": ("pt_ns", "max"), "arrived_ms": ("arrived_ms", "max"), "sample_count": ("pt_ns", "size")}
            for n in SCORES:
                aggs |= {f"{n}_{f}": (n, f) for f in ("count", "sum", "min", "max")}
            if arrival:
                aggs[arrival] = (arrival, "max")
            yield batch.groupby(["media_id", "bucket"], as_index=False, dropna=False).agg(**aggs)[[c.split()[0] for c in form.split(", ")]]

    processor = ClosingBuckets(CLOSED, delay_ns, idle_ms, arrival is not None)
    sums = slim.mapInPandas(summed, form)
    timed = sums if arrival is None else sums.withWatermark(arrival, arrival_delay)
    return stateful(timed, ["media_id"], processor, CLOSED, "ProcessingTime" if arrival is None else "EventTime")


def progress(stream: DataFrame, media: DataFrame) -> DataFrame:
    """Samples so far and their share of the declared frames, else of the duration; update mode."""
    rows = stream.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.max(F.struct("pt_ns", "duration_ns")).alias("_l")
    )
    m = media.select("media_id", "declared_frames", "duration_ns")
    by_time = (F.col("_l.pt_ns") + F.col("_l.duration_ns")) / F.col("m.duration_ns")
    ratio = (
        F.when(F.col("declared_frames") > 0, F.col("sample_count") / F.col("declared_frames"))
        .when(F.col("m.duration_ns") > 0, by_time)
        .otherwise(0.0)
    )
    return rows.join(m.alias("m"), "media_id").select(
        "media_id", "sample_count", F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)).alias("progress")
    )


def latest_requests(stream: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """Latest request per key of a stream; update mode."""
    body = [c for c in stream.columns if c not in keys]
    order = F.struct(generation, *[c for c in body if c != generation])
    return stream.groupBy(*keys).agg(F.max(order).alias("_r")).select(*keys, "_r.*")
