"""Headline timings. Prints one JSON line.

Queries run over $BENCH_SF_DIR; throughput jobs run over a sample table and image planes generated
by the formula of the published profile for many media, because one media is too small to measure.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MEDIA = int(os.environ.get("BENCH_MEDIA", "20"))
FRAMES = 180_000
TWO_HOURS_NS = 7200 * 1_000_000_000
PLANES = 8_000
PROBES = 500_000

# Published single-process rates, per second; the pair figure includes decoding.
PUBLISHED = {"lod_build_samples": 15_800_000, "pair_frames": 2_732, "lod_views": 31_193}

HEADLINE = [
    "lod_levels", "lod_view_combined", "scenes", "duplicate_ranges", "freezes", "asof_before", "asof_nearest",
    "keyframe_neighbours", "rows_in_ranges", "range_summary", "visual_search_topk", "frame_metrics", "pair_quality",
    "frame_range_plan", "sample_upsert", "telemetry_summary",
]


def session():
    from reelgrid.session import build_session, ship

    spark = build_session(
        f"local[{CPUS}]",
        "reelgrid-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.autoBroadcastJoinThreshold": str(10 << 20),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def timed(make) -> float:
    t = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - t


def best(make, runs: int = 2) -> float:
    return min(timed(make) for _ in range(runs))


def sample_table(spark, path: str):
    """n samples over two hours per media: periodic motion, a cut every 503 frames."""
    from pyspark.sql import functions as F

    i, m = F.col("id") % FRAMES, F.call_function("div", F.col("id"), F.lit(FRAMES))
    motion = ((i % 101) / F.lit(100.0)).cast("float")
    step = TWO_HOURS_NS // FRAMES
    df = spark.range(MEDIA * FRAMES, numPartitions=64).select(
        F.format_string("m%05d", m).alias("media_id"), i.alias("presentation_index"), i.alias("pts"), (i * step).alias("pt_ns"),
        F.lit(step).cast("bigint").alias("duration_ns"), (i % 50 == 0).alias("key_frame"), motion.alias("motion"),
        (1 - motion / 2).cast("float").alias("similarity"),
        F.when(i % 503 == 0, 0.95).otherwise(0.03).cast("float").alias("scene_score"),
        F.when(i > 0, 1 - motion / 10).cast("float").alias("duplicate_score"), (i % 7).alias("content_hash"),
        F.xxhash64(i % 90_000).alias("perceptual_hash"), F.lit(0).cast("bigint").alias("ingest_seq"),
    )
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plane_table(spark, path: str):
    """160x90 planes of a linear congruential generator, one seed per frame."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    def fill(batches):
        mask = (1 << 32) - 1
        for b in batches:
            s = (b.column("presentation_index").to_numpy() * 7919 + 1).astype(np.uint64)
            out = np.empty((len(s), 14_400), np.uint8)
            for k in range(14_400):
                s = (s * np.uint64(1664525) + np.uint64(1013904223)) & np.uint64(mask)
                out[:, k] = s >> np.uint64(24)
            side = lambda v: pa.array(np.full(len(s), v, np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("media_id"), b.column("presentation_index"), side(160), side(90), side(1), pa.array([r.tobytes() for r in out], pa.binary())],
                names=["media_id", "presentation_index", "width", "height", "channels", "data"],
            )

    rows = spark.range(PLANES, numPartitions=int(CPUS)).select(
        F.format_string("m%03d", F.col("id") % 40).alias("media_id"), F.call_function("div", F.col("id"), F.lit(40)).alias("presentation_index")
    )
    df = rows.mapInArrow(
        fill, "media_id string, presentation_index bigint, width int, height int, channels int, data binary"
    )
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def throughput(spark) -> dict[str, float]:
    import tempfile

    from pyspark.sql import functions as F

    from reelgrid.operators import asof, detect, lod, metrics, search
    from reelgrid.operators.order import arrange

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    samples = sample_table(spark, f"{folder}/samples")
    media = samples.groupBy("media_id").agg(F.lit(TWO_HOURS_NS).cast("bigint").alias("duration_ns"), F.count(F.lit(1)).alias("estimated"))
    media.write.mode("overwrite").parquet(f"{folder}/media")
    geometry = lod.lod_geometry(spark.read.parquet(f"{folder}/media"))
    rows = MEDIA * FRAMES
    out: dict[str, float] = {}
    out["lod_build_samples"] = rows / best(lambda: lod.build_lod(samples, geometry))
    lod.build_lod(samples, geometry).repartitionByRange(int(CPUS), "level", "media_id", "bucket").sortWithinPartitions(
        "level", "media_id", "bucket"
    ).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/lod")
    stored = spark.read.parquet(f"{folder}/lod")
    views = spark.range(MEDIA * 200).select(
        F.format_string("m%05d", F.col("id") % MEDIA).alias("media_id"), F.col("id").cast("string").alias("request_id"),
        (F.col("id") * 31_000_000_000 % (TWO_HOURS_NS - 900_000_000_000)).alias("start_ns"), F.lit(1920).alias("budget"),
    ).withColumn("end_ns", F.col("start_ns") + 900_000_000_000)
    out["lod_views"] = MEDIA * 200 / best(
        lambda: lod.lod_view(stored, views, geometry).groupBy("request_id", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("motion_avg").alias("a"))
    )
    def found():
        p = detect.prepare(arrange(samples))
        return detect.scenes(p).unionByName(detect.duplicate_ranges(p)).unionByName(detect.freezes(p))

    out["detection_samples"] = rows / best(found, 1)
    probes = spark.range(PROBES).select(
        F.format_string("m%05d", F.col("id") % MEDIA).alias("media_id"), F.col("id").alias("probe_id"),
        (F.col("id") * 7_919_000_003 % TWO_HOURS_NS).alias("target_ns"),
    )
    out["asof_probes"] = PROBES / best(lambda: asof.asof(probes, arrange(samples), ["key_frame"]), 1)
    queries = samples.where("presentation_index = 90000").limit(100).select(
        F.col("media_id").alias("query_id"), "media_id", F.col("perceptual_hash").alias("q_hash"), F.col("pt_ns").alias("q_time"),
        F.col("presentation_index").alias("q_index"),
    )
    out["search_comparisons"] = rows / best(lambda: search.find_similar(queries, samples), 1)
    planes = plane_table(spark, f"{folder}/planes")
    out["pair_frames"] = PLANES / best(lambda: metrics.analyse_planes(planes))
    return out


def main() -> None:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from reelgrid.registry import CATALOGUE

    spark = session()
    times = {}
    for name in HEADLINE:
        run = CATALOGUE[name].run
        times[name] = round(best(lambda: run(spark, SF_DIR)), 3)
    rates = throughput(spark) if os.environ.get("BENCH_RATES", "1") == "1" else {}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                "per_second": {k: round(v) for k, v in rates.items()},
                "published_per_second": PUBLISHED,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
