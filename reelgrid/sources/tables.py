"""Table readers and writers.

Layouts: samples are partitioned by algorithm version and sorted by (media_id, pt_ns), so range
reads prune row groups; planes are kept apart and clustered by (media_id, presentation_index).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..config import ALGORITHM_VERSION, SCHEMA_VERSION
from ..functions import metadata as M
from ..functions.timebase import pts_to_ns
from ..operators.metrics import valid_planes
from ..operators.samples import split_valid
from ..schemas import SCHEMAS
from ..session import materialise

UNKNOWN = -1
VERSION = "result_version"
VERSIONS = f"{VERSION} string, published bigint, whole boolean, schema string, parts string, by string"


def _read(spark: SparkSession, path: str, table: str, fmt: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).format(fmt).load(path)


def valid_media(media: DataFrame) -> DataFrame:
    """Media with a usable time base."""
    return media.where((F.col("time_base.num") > 0) & (F.col("time_base.den") > 0))


def read_media(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return valid_media(_read(spark, path, "media", fmt))


def read_frames(spark: SparkSession, path: str, media: DataFrame, fmt: str = "parquet") -> DataFrame:
    return resolve_frames(_read(spark, path, "frames", fmt), media)


def resolve_frames(raw: DataFrame, media: DataFrame) -> DataFrame:
    """Frames with identity, time, duration, colour and bit depth resolved against their media.

    ``duration_ns`` of raw rows is in stream ticks where ``pt_ns`` is not given yet.
    """
    m = media.select(
        "media_id",
        F.col("time_base").alias("_tb"),
        F.col("stream_start_pts").alias("_origin"),
        F.col("color").alias("_color"),
        F.col("bit_depth").alias("_depth"),
    )
    j = raw.join(m, "media_id")
    ts = M.presentation_timestamp(F.col("best_effort_pts"), F.col("pts"), F.col("dts"))
    ticks = M.declared_duration(F.col("duration_ns"))
    zero = F.lit(0).cast("bigint")
    # A pts of 0 in an absent slot would shift the order, so nulls stay nulls throughout.
    resolved = {
        "pt_ns": F.coalesce("pt_ns", pts_to_ns(ts, F.col("_origin"), F.col("_tb"))),
        "duration_ns": F.when(F.col("pt_ns").isNotNull(), ticks).otherwise(
            F.coalesce(pts_to_ns(ticks, zero, F.col("_tb")), zero)
        ),
        "pts": M.identity_pts(F.col("best_effort_pts"), F.col("pts")),
        "color": M.color_or_stream(F.col("color"), F.col("_color")),
        "bit_depth": M.bit_depth_or_stream(F.col("bit_depth"), F.col("_depth")),
        "presentation_index": F.when(F.col("presentation_index") >= 0, F.col("presentation_index")),
    }
    return j.withColumns(resolved).select(*raw.columns)


def read_planes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Planes whose data length agrees with their geometry."""
    return valid_planes(_read(spark, path, "planes", fmt))


def write_planes(planes: DataFrame, path: str) -> None:
    (
        planes.repartitionByRange("media_id", "presentation_index")
        .sortWithinPartitions("media_id", "presentation_index")
        .write.mode("overwrite")
        .parquet(path)
    )


def with_fingerprint(media: DataFrame) -> DataFrame:
    return media.withColumn(
        "fingerprint", M.media_fingerprint(F.col("path"), F.col("file_size"), F.col("mtime_ms"), F.col("stream_index"))
    )


def write_samples(samples: DataFrame, media: DataFrame, path: str, complete: bool = True) -> str:
    """Store the samples of whole media under the media's current fingerprint; returns the run's id.

    A run writes its rows under its own id and then publishes itself in ``status``, one row per media.
    The latest published run of a media replaces all earlier ones, so a repeated write doubles nothing,
    and what a failed run left behind is never read. Media with any invalid sample go to
    ``<path>/quarantine`` instead. Rows are range-partitioned in time, so a media of any length is
    written by many tasks. The input is evaluated once.
    """
    spark, run = samples.sparkSession, uuid.uuid4().hex
    prints = with_fingerprint(media).select("media_id", "fingerprint")
    good, bad = split_valid(materialise(samples))
    stamped = good.join(prints, "media_id").withColumns(
        {"algo_version": F.lit(ALGORITHM_VERSION), "schema_version": F.lit(SCHEMA_VERSION), "run": F.lit(run)}
    )
    (
        stamped.repartitionByRange("media_id", "pt_ns", "presentation_index")
        .sortWithinPartitions("media_id", "pt_ns", "presentation_index")
        .write.mode("append")
        .partitionBy("algo_version", "run")
        .parquet(f"{path}/data")
    )
    bad.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/quarantine")
    written = spark.read.schema(stamped.schema).parquet(f"{path}/data").where(F.col("run") == run)
    status = written.groupBy("media_id", "fingerprint", "schema_version", "algo_version", "run").agg(
        F.count(F.lit(1)).alias("samples")
    )
    published = status.withColumns({"complete": F.lit(complete), "published": F.lit(time.time_ns())})
    published.write.mode("append").parquet(f"{path}/status")
    return run


def latest_status(status: DataFrame) -> DataFrame:
    """The latest published row per media and fingerprint, of the current versions."""
    current = status.where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("algo_version") == ALGORITHM_VERSION))
    if "published" not in status.columns:
        return current
    body = [c for c in status.columns if c not in ("media_id", "fingerprint")]
    last = F.max_by(F.struct(*body), F.struct("published", "run")).alias("_s")
    return current.groupBy("media_id", "fingerprint").agg(last).select("media_id", "fingerprint", "_s.*")


def read_samples(spark: SparkSession, media: DataFrame, path: str, complete_only: bool = False) -> DataFrame:
    """Stored samples that still belong to their media: the latest run of the current fingerprint."""
    prints = with_fingerprint(media).select("media_id", "fingerprint")
    runs = latest_status(spark.read.parquet(f"{path}/status")).join(prints, ["media_id", "fingerprint"], "left_semi")
    if complete_only:
        runs = runs.where("complete")
    stored = spark.read.parquet(f"{path}/data").where(F.col("algo_version") == ALGORITHM_VERSION)
    return stored.join(runs.select("media_id", "fingerprint", "run"), ["media_id", "fingerprint", "run"], "left_semi").drop(
        "fingerprint", "schema_version", "algo_version", "run"
    )


def pending_media(media: DataFrame, status: DataFrame) -> DataFrame:
    """Media whose latest stored document of their current fingerprint is not complete, or missing."""
    done = latest_status(status).where("complete").select("media_id", "fingerprint").distinct()
    return with_fingerprint(media).join(done, ["media_id", "fingerprint"], "left_anti").drop("fingerprint")


def write_results(
    df: DataFrame, path: str, by: tuple[str, ...] = ("kind",), order: tuple[str, ...] = (), whole: bool = False, publish: bool = True
) -> str:
    """Detections, LOD or manifests as a new version, partitioned by columns of few values; returns its id.

    A version is written under its own id and published last, by one small file in ``versions``, so a
    reader sees all of it or nothing, and files it reads are never replaced. A version replaces the
    partitions present in it; with ``whole`` it replaces everything before it, also when it is empty.
    ``publish=False`` leaves that to ``publish_results``. Inside a partition rows are sorted by media, so
    reads of one media prune row groups; a folder per media would make millions of small files.
    """
    version = uuid.uuid4().hex
    keys = [*by, "media_id", *order]
    stamped = df.withColumn(VERSION, F.lit(version))
    (
        stamped.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("append")
        .partitionBy(VERSION, *by)
        .parquet(f"{path}/data")
    )
    if publish:
        publish_results(df.sparkSession, path, version, stamped.schema, by, whole)
    return version


def publish_results(spark: SparkSession, path: str, version: str, schema: StructType, by: tuple[str, ...] = ("kind",), whole: bool = False) -> None:
    """Make a written version visible. ``schema``: that of its rows."""
    if VERSION not in schema.names:
        schema = StructType([*schema.fields, StructField(VERSION, StringType())])
    written = spark.read.schema(schema).parquet(f"{path}/data").where(F.col(VERSION) == version)
    parts = written.select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("parts")) if by else None
    parts = parts if parts is not None else spark.range(1).select(F.array().cast("array<struct<_:int>>").alias("parts"))
    parts.select(
        F.lit(version).alias(VERSION), F.lit(time.time_ns()).alias("published"), F.lit(whole or not by).alias("whole"),
        F.lit(schema.json()).alias("schema"), F.to_json("parts").alias("parts"), F.lit(",".join(by)).alias("by"),
    ).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The published rows: of every partition, those of the latest version that has it."""
    versions = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    latest = F.struct("published", VERSION)
    # Two rows at most: the newest version and the newest that replaced everything.
    heads = versions.agg(F.max_by(F.struct("schema", "by"), latest).alias("last"), F.max(F.when(F.col("whole"), latest)).alias("floor")).first()
    schema = StructType.fromJson(json.loads(heads["last"]["schema"]))
    by = [c for c in heads["last"]["by"].split(",") if c]
    live = versions
    if heads["floor"] is not None:
        live = versions.where(latest >= F.struct(F.lit(heads["floor"]["published"]), F.lit(heads["floor"][VERSION])))
    rows = spark.read.schema(schema).parquet(f"{path}/data")
    if not by:
        return rows.join(live.orderBy(F.desc("published"), F.desc(VERSION)).limit(1).select(VERSION), VERSION, "left_semi").drop(VERSION)
    kinds = StructType([schema[c] for c in by])
    each = live.select(VERSION, "published", F.inline(F.from_json("parts", ArrayType(kinds))))
    newest = each.groupBy(*by).agg(F.max_by(VERSION, latest).alias(VERSION)).select(VERSION, *[F.col(c).alias(f"_{c}") for c in by])
    match = rows[VERSION] == newest[VERSION]
    for c in by:
        match = match & rows[c].eqNullSafe(newest[f"_{c}"])
    return rows.join(newest, match, "left_semi").drop(VERSION)


def stream_samples(spark: SparkSession, path: str, files_per_trigger: int = 32) -> DataFrame:
    """Newly analysed rows as they arrive in a folder."""
    return (
        spark.readStream.schema(SCHEMAS["samples"])
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
