"""Requests answered with the frames of whole media, against the lookups that join."""

import random

import pytest
from pyspark.sql import functions as F

from reelgrid.plans import selection as P
from reelgrid.plans import sheets as H

FRAMES = "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, key_frame boolean"
SHEET = "struct<frame_count: int, rows: int, columns: int, with_time: boolean, with_index: boolean>"
REQUESTS = f"request_id string, media_id string, range_start_ns bigint, range_end_ns bigint, target_times array<bigint>, sheet {SHEET}"


def tables(spark):
    rng = random.Random(11)
    frames = [
        (f"m{m}", rng.choice([k, k, k - 1, None, -1]), rng.choice([k, None]), rng.choice([k * 10, k * 10, 50, None]), rng.random() < 0.3)
        for m in range(6) for k in range(rng.choice([1, 9, 30]))
    ]
    requests = []
    for k in range(120):
        a = rng.randrange(-20, 300)
        times = rng.choice([None, [], sorted({rng.randrange(-50, 400) for _ in range(6)})])
        requests.append((f"r{k}", f"m{rng.randrange(8)}", a, a + rng.choice([0, 7, 90]), times, (rng.choice([1, 4, 9]), 3, 3, True, True)))
    return spark.createDataFrame(list(dict.fromkeys(frames)), FRAMES), spark.createDataFrame(requests, REQUESTS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def dealt(spark):
    """Tables that are joined by shuffles, so that both sides are dealt out by media."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name, run, columns", [
    ("target", lambda r, f: P.target_plan(r, f), ("request_id", "media_id", "seq", "target_ns", "presentation_index", "pt_ns")),
    ("sheet", lambda r, f: H.overview_sheet(r, f), ("request_id", "media_id", "cell", "row", "column", "target_ns", "label")),
])
def test_targets_are_no_rows(spark, monkeypatch, dealt, name, run, columns):
    """Each target was a row that was shuffled to be looked up, joined back, grouped and numbered."""
    frames, requests = tables(spark)
    with_media = requests.join(requests.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")), "media_id").select(*requests.columns)
    spark.conf.set("reelgrid.chunk.rows", "5")
    want = rows(run(requests, frames), *columns)
    spark.conf.unset("reelgrid.chunk.rows")
    for module in (P, H):
        monkeypatch.setattr(module, "asof", lambda *a: pytest.fail("targets as rows"))
    assert want and rows(run(with_media, frames), *columns) == want


@pytest.mark.parametrize("keyframes", [False, True])
def test_picks_are_not_joined_to_their_frames(spark, monkeypatch, dealt, keyframes):
    frames, requests = tables(spark)
    requests = requests.withColumns({"every_n": F.lit(2), "max_frames": F.when(F.col("range_start_ns") % 3 > 0, 3), "base_name": F.col("request_id")})
    requests = requests.withColumn("max_frames", F.coalesce("max_frames", F.lit(100)))
    columns = ("request_id", "media_id", "seq", "limit_reached", "pt_ns", "presentation_index", "key_frame")
    spark.conf.set("reelgrid.chunk.rows", "5")
    want = rows(P.range_plan(requests, frames, keyframes), *columns)
    spark.conf.unset("reelgrid.chunk.rows")
    monkeypatch.setattr(P, "_swept", lambda *a: pytest.fail("picks joined by position"))
    got = P.range_plan(requests, frames, keyframes, keep=("base_name",))
    assert want and rows(got, *columns) == want and got.where("base_name <> request_id").isEmpty()
