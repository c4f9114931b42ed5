"""Literal cases with exact expectations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.config import MS, SECOND, LodConfig
from reelgrid.functions import metadata as M
from reelgrid.functions import naming as N
from reelgrid.functions import pixels as X
from reelgrid.functions import spacing as G
from reelgrid.functions import timebase as B
from reelgrid.operators import asof, compare, lod, markers, metrics, ranges, samples, search, steps
from reelgrid.plans import requests as Q
from reelgrid.plans import strips as W
from reelgrid.streaming.progressive import next_detection
from reelgrid.streaming.stateful import ABSENT, VisitHistory


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def tb(num, den):
    return F.struct(F.lit(num).alias("num"), F.lit(den).alias("den"))


def big(v):
    return F.lit(v).cast("bigint")


# --- time base -----------------------------------------------------------------------------


def test_rescale(spark):
    low, high = -(2**63), 2**63 - 1
    r = one(
        spark,
        there=B.pts_to_ns(big(91_125), big(90_000), tb(1, 90_000)),
        back=B.ns_to_pts(big(12_500_000), big(90_000), tb(1, 90_000)),
        half=B.pts_to_ns(big(-1), big(0), tb(1, 2_000_000_000)),
        half_up=B.pts_to_ns(big(1), big(0), tb(1, 2_000_000_000)),
        none=B.pts_to_ns(F.lit(None).cast("bigint"), big(0), tb(1, 2)),
        bad=B.pts_to_ns(big(1), big(0), tb(1, 0)),
        over=B.pts_to_ns(big(2**62), big(0), tb(1, 1)),
        top=B.pts_to_ns(big(high), big(0), tb(1, 1_000_000_000)),
        gap=B.pts_to_ns(big(high), big(-5), tb(1, 1_000_000_000)),
        film=B.nominal_frame_duration(tb(24_000, 1_001)),
        zero=B.nominal_frame_duration(tb(0, 1)),
        label=B.format_timestamp(big(3_723_004_999_999)),
        early=B.format_timestamp(big(-5)),
    )
    assert (r.there, r.back) == (12_500_000, 91_125)
    assert (r.half, r.half_up) == (-1, 1)
    assert r.none is None and r.bad is None
    assert r.over == low + 1 and r.top == high and r.gap == high - 1
    assert abs(r.film - 41_708_333) <= 1 and r.zero == 0
    assert (r.label, r.early) == ("01:02:03.004", "00:00:00.000")


def test_rescale_equals_integer_model(spark):
    rng = np.random.default_rng(3)
    rows = [
        (int(t), int(o), int(n), int(d))
        for t, o, n, d in zip(
            rng.integers(-(10**12), 10**12, 300), rng.integers(-(10**6), 10**6, 300), rng.integers(1, 2000, 300), rng.integers(1, 10**6, 300)
        )
    ]
    df = spark.createDataFrame(rows, "t bigint, o bigint, n int, d int")
    got = df.select("t", "o", "n", "d", B.pts_to_ns(F.col("t"), F.col("o"), F.struct(F.col("n").alias("num"), F.col("d").alias("den"))).alias("ns"))
    for t, o, n, d, ns in got.collect():
        x = abs(t - o) * n * 10**9
        want = (2 * x + d) // (2 * d) * (1 if t >= o else -1)
        assert ns == (want if abs(want) < 2**63 else -(2**63) + 1)


# --- metadata and names --------------------------------------------------------------------


def test_hdr_values_and_absence(spark):
    point = lambda x, y: F.struct(tb(x, 50_000).alias("x"), tb(y, 50_000).alias("y"))
    raw = lambda p, l: F.struct(
        F.lit(p).alias("has_primaries"), F.lit(l).alias("has_luminance"),
        F.struct(point(34_000, 16_000).alias("red"), point(13_250, 34_500).alias("green"), point(7_500, 3_000).alias("blue"), point(15_635, 16_450).alias("white")).alias("primaries"),
        F.struct(tb(1, 10_000).alias("min"), tb(1_000, 1).alias("max")).alias("luminance"),
    )
    r = one(spark, full=M.mastering_display(raw(True, True)), half=M.mastering_display(raw(False, True)), none=M.mastering_display(raw(False, False)),
            light=M.content_light(F.lit(1000), F.lit(400)), dark=M.content_light(F.lit(None).cast("int"), F.lit(None).cast("int")))
    assert r.full.primaries.red.x == pytest.approx(0.68) and r.full.primaries.white.x == pytest.approx(0.3127)
    assert r.full.luminance.min == pytest.approx(0.0001) and r.full.luminance.max == 1000.0
    assert r.half.primaries is None and r.half.luminance.max == 1000.0
    assert r.none is None and r.dark is None and r.light.max_cll == 1000


def test_names(spark):
    f = lambda s: N.sanitize_base_name(F.lit(s))
    r = one(
        spark, a=f("  bad:name.  "), b=f(" .. "), c=f(""), d=f('x/y\\z|?*"<>\x01'), e=f("n" * 200),
        by_index=N.frame_file_name(F.lit("clip"), big(1), big(12), big(5), F.lit("png")),
        by_time=N.frame_file_name(F.lit("clip"), big(2), F.lit(None).cast("bigint"), big(5), F.lit("jpeg")),
    )
    assert (r.a, r.b, r.c, r.d) == ("bad_name", "frame", "frame", "x_y_z_______")
    assert len(r.e) == 96
    assert r.by_index == "clip_000001_f00000012.png"
    assert r.by_time == "clip_000002_t0000000000000000005.jpg"


def test_spacing_and_grids(spark):
    r = one(
        spark, a=G.evenly_spaced(big(0), big(10), big(4)), b=G.evenly_spaced(big(2), big(8), big(1)), c=G.evenly_spaced(big(0), big(9), big(0)),
        g=F.array(*[F.array(G.grid_columns(F.lit(n)), G.grid_rows(F.lit(n))) for n in (8, 16, 20, 25, 7, 1)]),
    )
    assert r.a == [0, 3, 6, 10] and r.b == [2] and r.c == []
    assert [tuple(x) for x in r.g] == [(4, 2), (4, 4), (5, 4), (5, 5), (3, 3), (1, 1)]


def test_request_normalisation(spark):
    row = ("r", "m", "  bad:name.  ", 20 * SECOND, 8 * SECOND, 2 * SECOND, 0, 0, 140, [-SECOND, 3 * SECOND, 3 * SECOND, 20 * SECOND], ("range", 90, 90, 9999, 1, 5000, True, True))
    schema = (
        "request_id string, media_id string, base_name string, anchor_ns bigint, range_start_ns bigint, range_end_ns bigint, every_n bigint, "
        "max_frames bigint, quality int, target_times array<bigint>, sheet struct<source:string,rows:int,columns:int,frame_count:int,cell_w:int,cell_h:int,with_time:boolean,with_index:boolean>"
    )
    media = spark.createDataFrame([("m", 10 * SECOND, 100)], "media_id string, duration_ns bigint, declared_frames bigint")
    r = Q.normalise_requests(spark.createDataFrame([row], schema), media).first()
    assert (r.range_start_ns, r.range_end_ns, r.anchor_ns) == (2 * SECOND, 8 * SECOND, 10 * SECOND)
    assert (r.every_n, r.max_frames, r.quality, r.base_name, r.target_times) == (1, 1, 100, "bad_name", [0])
    assert (r.sheet.rows, r.sheet.columns, r.sheet.frame_count, r.sheet.cell_w, r.sheet.cell_h) == (32, 32, 1024, 64, 1080)
    total = Q.estimated_total(Q.normalise_requests(spark.createDataFrame([row[:7] + (500,) + row[8:]], schema), media), media).first()
    assert total.estimated_total == 60


# --- pixels --------------------------------------------------------------------------------


def planes(spark, rows):
    return spark.createDataFrame(
        [("m", i, w, h, 1, bytearray(d)) for i, (w, h, d) in enumerate(rows)],
        "media_id string, presentation_index bigint, width int, height int, channels int, data binary",
    )


def test_frame_scores(spark):
    black, white = bytes(16), bytes([255] * 16)
    half = bytes([255] * 8 + [0] * 8)
    rows = [(4, 4, black), (4, 4, black), (4, 4, white), (4, 4, black), (4, 4, half), (2, 8, half)]
    got = sorted(metrics.analyse_planes(planes(spark, rows)).collect(), key=lambda r: r.presentation_index)
    assert got[0].motion is None and got[0].status == "first"
    assert (got[1].motion, got[1].similarity, got[1].duplicate_score, got[1].scene_score) == (0, 1, 1, 0)
    assert got[2].motion == 1 and got[2].similarity < 0.01 and got[2].scene_score > 0.99 and got[2].duplicate_score < 0.01
    assert got[4].motion == pytest.approx(0.5, abs=1e-3) and 0.4 < got[4].similarity < 0.6
    assert got[5].status == "geometry_mismatch" and got[5].motion is None
    assert got[0].content_hash == got[1].content_hash != got[2].content_hash
    assert got[0].perceptual_hash != got[2].perceptual_hash


@pytest.mark.parametrize("chunk", [None, "3"])
def test_ranges_compare_each_plane_once(spark, chunk):
    """Overlapping and single-frame ranges, times out of the order of the index, a plane of another size."""
    times = [0, 1, 2, 9, 3, 4, 5, 6, 7, 8, 10, 11]
    datas = [(4, 4, bytes([17 * i % 251] * 8 + [5 * i] * 8)) for i in range(12)]
    datas[6] = (2, 8, datas[6][2])
    spans = {"all": (0, 11, 0), "early": (0, 8, 0), "late": (3, 9, 0), "one": (5, 5, 0), "back": (6, 4, 0)}
    frames = spark.createDataFrame(
        [("m", i, t, t, 1, False) for i, t in enumerate(times)], "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, duration_ns bigint, key_frame boolean"
    )
    ranges = spark.createDataFrame([("m", k, a, b) for k, (a, b, _) in spans.items()], "media_id string, range_id string, start_ns bigint, end_ns bigint")
    if chunk:
        spark.conf.set("reelgrid.chunk.rows", chunk)
    try:
        for preroll in (0, 2):
            got = {(r.range_id, r.presentation_index): r.motion for r in metrics.analyse_ranges(planes(spark, datas), frames, ranges, preroll).collect()}
            want = {}
            for name, (a, b, _) in spans.items():
                a, b = min(a, b), max(a, b)
                read = [i for i, t in enumerate(times) if max(a - preroll, 0) <= t <= b]
                for i, before in zip(read, [None, *read]):
                    if times[i] < a or (before is not None and datas[i][:2] != datas[before][:2]):
                        continue
                    pair = zip(datas[i][2], datas[before][2]) if before is not None else ()
                    want[name, i] = None if before is None else pytest.approx(sum(abs(x - y) for x, y in pair) / (255 * 16), abs=1e-6)
            assert got == want
    finally:
        spark.conf.unset("reelgrid.chunk.rows")


def plain_fnv(data, w, h):
    x = 14695981039346656037
    mixed = list(data) + [b for s in (0, 8, 16, 24) for b in ((w >> s) & 255, (h >> s) & 255)]
    for b in mixed:
        x = ((x ^ b) * 1099511628211) % 2**64
    return x - 2**64 if x >= 2**63 else x


def plain_phash(data, w, h):
    means = []
    for by in range(8):
        for bx in range(8):
            y0, x0 = by * h // 8, bx * w // 8
            y1, x1 = max(y0 + 1, (by + 1) * h // 8), max(x0 + 1, (bx + 1) * w // 8)
            v = [data[y * w + x] for y in range(y0, min(y1, h)) for x in range(x0, min(x1, w))]
            means.append(sum(v) // max(1, len(v)))
    bits = [means[y * 8 + x] >= means[y * 8 + x + 1] for y in range(8) for x in range(7)]
    x = sum(1 << i for i, b in enumerate(bits) if b) | ((sum(means) // 64) & 255) << 56
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("w,h", [(8, 8), (5, 3), (160, 90), (17, 13)])
def test_hashes_equal_plain_model(w, h):
    rng = np.random.default_rng(w)
    block = rng.integers(0, 256, (3, w * h), dtype=np.uint8)
    assert X.content_hash(block, w, h).tolist() == [plain_fnv(r.tolist(), w, h) for r in block]
    assert X.perceptual_hash(block, w, h).tolist() == [plain_phash(r.tolist(), w, h) for r in block]


def test_comparison(spark):
    solid = lambda w, h, v: (w, h, 3, bytearray([v] * (w * h * 3)))
    touched = bytearray([9] * (17 * 13 * 3))
    touched[30] = 200
    cases = [
        (1, *solid(24, 16, 7), *solid(24, 16, 7)), (2, *solid(16, 16, 0), *solid(16, 16, 255)),
        (3, *solid(17, 13, 9), 17, 13, 3, touched), (4, *solid(16, 16, 0), *solid(12, 16, 0)),
        (5, *solid(16, 16, 0), None, None, None, None),
    ]
    cols = ", ".join(f"{s}_width int, {s}_height int, {s}_channels int, {s}_data binary" for s in "ab")
    got = {r.pair_id: r for r in compare.compare_pairs(spark.createDataFrame(cases, "pair_id bigint, " + cols)).collect()}
    assert (got[1].ssim, got[1].psnr, got[1].mse) == (1.0, math.inf, 0.0)
    assert got[2].ssim < 0.001 and got[2].psnr == 0 and got[2].mse == 65025
    assert 0 <= got[3].ssim < 1
    assert not got[4].comparable and "16x16 vs 12x16" in got[4].detail
    assert not got[5].comparable and got[5].detail


def test_equal_images(spark):
    cols = ", ".join(f"{s}_width int, {s}_height int, {s}_channels int, {s}_data binary" for s in "ab")
    a, b, c = (2, 2, 1, bytearray(4)), (2, 2, 1, bytearray([0, 0, 0, 1])), (4, 1, 1, bytearray(4))
    df = spark.createDataFrame([(1, *a, *a), (2, *a, *b), (3, *a, *c)], "pair_id bigint, " + cols)
    assert {r.pair_id: r.equal for r in metrics.equal_images(df).collect()} == {1: True, 2: False, 3: False}


# --- samples, LOD, lookups -----------------------------------------------------------------


def sample_rows(spark, rows):
    return spark.createDataFrame(
        rows, "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, duration_ns bigint, motion float, similarity float, scene_score float, ingest_seq bigint"
    )


def test_lod_and_replacement(spark):
    m = [i / 100 for i in range(16)]
    rows = [("m", i, i, i * SECOND, 0, m[i], 1 - m[i], None, i) for i in range(16)]
    cfg = LodConfig(base_buckets=16)
    media = spark.createDataFrame([("m", 16 * SECOND, 16)], "media_id string, duration_ns bigint, estimated bigint")
    g = lod.lod_geometry(media, cfg)
    view = spark.createDataFrame([("m", "v", 0, 16 * SECOND, 4)], "media_id string, request_id string, start_ns bigint, end_ns bigint, budget int")
    built = lod.build_lod(sample_rows(spark, rows), g, cfg)
    got = sorted(lod.lod_view(built, view, g, cfg).collect(), key=lambda r: r.bucket)
    assert [r.level for r in got] == [1] * 4 and got[0].source_buckets == 4
    b = got[0]
    assert b.sample_count == 4 and b.motion_avg == pytest.approx(0.015) and b.motion_min == 0 and b.motion_max == pytest.approx(0.03)
    assert b.similarity_avg == pytest.approx(0.985) and b.scene_avg is None
    rows[5] = ("m", 5, 5, 5 * SECOND, 0, 1.0, 0.0, None, 99)
    changed = spark.createDataFrame([("m", 5 * SECOND, 5 * SECOND)], "media_id string, start_ns bigint, end_ns bigint")
    new = lod.replace_range(built, changed, sample_rows(spark, rows), g, cfg)
    fixed = {(r.level, r.bucket): r for r in new.collect()}
    assert len(fixed) == built.count()
    assert fixed[(1, 1)].sample_count == 4 and fixed[(1, 1)].motion_sum / 4 == pytest.approx(0.2925)
    assert fixed[(2, 0)].motion_max == 1.0 and fixed[(0, 5)].sample_count == 1


def test_lod_bounds(spark):
    cfg = LodConfig(base_buckets=1024)
    media = spark.createDataFrame([("m", 24 * 3600 * SECOND, 10_000_000)], "media_id string, duration_ns bigint, estimated bigint")
    g = lod.lod_geometry(media, cfg)
    r = g.first()
    assert r.buckets <= 1024 and r.levels >= 6
    rows = [("m", i, i, i * 84 * SECOND, 0, 0.5, 0.5, None, i) for i in range(1024)]
    built = lod.build_lod(sample_rows(spark, rows), g, cfg)
    views = spark.createDataFrame([("m", n, 0, 24 * 3600 * SECOND, n) for n in (320, 1)], "media_id string, request_id int, start_ns bigint, end_ns bigint, budget int")
    got = lod.lod_view(built, views, g, cfg).collect()
    wide = [r for r in got if r.request_id == 320]
    assert wide[0].level > 0 and len(wide) <= 320 and len([r for r in got if r.request_id == 1]) == 1


def test_upsert_nearest_and_range(spark):
    row = lambda i, t, m, q: ("m", i, i, t * MS, 0, m, None, None, q)
    stored = sample_rows(spark, [row(2, 80, 0.1, 1), row(0, 0, 0.1, 2), row(1, 40, 0.1, 3)])
    merged = samples.upsert_samples(stored, sample_rows(spark, [row(1, 40, 0.75, 4)]))
    assert merged.count() == 3
    probe = spark.createDataFrame([("m", 1, 40 * MS, 1, None)], "media_id string, probe_id bigint, target_ns bigint, index_hint bigint, tolerance_ns bigint")
    assert asof.nearest_sample(probe, merged, ["motion"]).first().hit.motion == 0.75
    r = spark.createDataFrame([("m", "r", 90 * MS, 20 * MS)], "media_id string, range_id string, start_ns bigint, end_ns bigint")
    inside = ranges.rows_in_ranges(merged, r).collect()
    assert sorted(x.presentation_index for x in inside) == [1, 2]


def test_unindexed_identity(spark):
    rows = [("m", 1, 5, 10, 0, 0.1, None, None, 1), ("m", None, 5, 10, 0, 0.2, None, None, 2), ("m", None, 6, 10, 0, 0.3, None, None, 3), ("m", None, 6, 10, 0, 0.4, None, None, 4)]
    got = samples.upsert_samples(sample_rows(spark, rows[:2]), sample_rows(spark, rows[2:])).collect()
    assert sorted((r.presentation_index, r.pts, round(r.motion, 1)) for r in got if r.presentation_index) == [(1, 5, 0.1)]
    assert [(r.pts, round(r.motion, 1)) for r in got if r.presentation_index is None] == [(6, 0.4)]


def test_asof_ties_and_ends(spark):
    frames = spark.createDataFrame([("m", i, i, t) for i, t in enumerate([0, 10, 10, 30])], "media_id string, presentation_index bigint, pts bigint, pt_ns bigint")
    p = [("m", k, t) for k, t in enumerate([-5, 0, 10, 20, 31, 12])]
    probes = spark.createDataFrame(p, "media_id string, probe_id bigint, target_ns bigint")
    run = lambda bias: {r.probe_id: r.hit and r.hit.presentation_index for r in asof.asof(probes, frames, [], bias).collect()}
    assert run("at_or_before") == {0: None, 1: 0, 2: 2, 3: 2, 4: 3, 5: 2}
    assert run("at_or_after") == {0: 0, 1: 0, 2: 1, 3: 3, 4: 3, 5: 3}
    assert run("nearest") == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 2}


def test_visual_search(spark):
    hashes = [0, 3, 1, None, -1]
    rows = [("m", i, i * SECOND, h) for i, h in enumerate(hashes)]
    s = spark.createDataFrame(rows, "media_id string, presentation_index bigint, pt_ns bigint, perceptual_hash bigint")
    q = spark.createDataFrame([(1, "m", 0, 0, 0)], "query_id bigint, media_id string, q_hash bigint, q_time bigint, q_index bigint")
    for radius in (8, 7, 4):
        got = sorted(search.find_similar(q, s, 8, radius).collect(), key=lambda r: r.rank)
        assert [(r.presentation_index, r.hamming) for r in got] == [(2, 1), (1, 2)]


def test_range_summary(spark):
    frames = spark.createDataFrame([("m", i, i, i * 10) for i in (0, 1, 2, 4, 5)], "media_id string, presentation_index bigint, pts bigint, pt_ns bigint")
    r = spark.createDataFrame(
        [("m", "whole", 0, 20), ("m", "gap", 20, 40), ("m", "edge", 0, 25), ("m", "none", 26, 39), ("m", "swap", 50, 40)],
        "media_id string, range_id string, start_ns bigint, end_ns bigint",
    )
    got = {x.range_id: (x.first_frame, x.last_frame, x.known_count, x.frame_count) for x in ranges.range_summary(r, frames).collect()}
    assert got == {"whole": (0, 2, 3, 3), "gap": (2, 4, 2, None), "edge": (0, 2, 3, None), "none": (None, None, 0, None), "swap": (4, 5, 2, 2)}


def test_steps_stop_at_the_ends(spark):
    frames = spark.createDataFrame([("m", i, i, i * 10, i == 0) for i in range(5)], "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, key_frame boolean")
    st = spark.createDataFrame([("m", 1, 2), ("m", 1, -9), ("m", 4, 1), ("m", 2, 5000)], "media_id string, presentation_index bigint, step bigint")
    got = {(r.presentation_index, r.step): r.reached and r.reached.presentation_index for r in steps.step_frames(st, frames).collect()}
    assert got == {(1, 2): 3, (1, -9): 0, (4, 1): None, (2, 5000): 4}


# --- strips, markers, history --------------------------------------------------------------


def test_strips(spark):
    frames = spark.createDataFrame(
        [("m", 100 + i, i, i * 20 * MS, 20 * MS, i == 0, 77) for i in range(12)],
        "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, duration_ns bigint, key_frame boolean, serial bigint",
    )
    media = spark.createDataFrame([("m", SECOND), ("e", SECOND)], "media_id string, duration_ns bigint")
    probes = spark.createDataFrame([(1, "m", 100 * MS, 8), (2, "e", 500 * MS, 8)], "probe_id bigint, media_id string, target_ns bigint, count int")
    got = W.context_window(probes, frames, media).collect()
    exact = sorted((r for r in got if r.probe_id == 1), key=lambda r: r.ordinal)
    assert all(r.exact for r in exact) and [r.index_hint for r in exact] == list(range(101, 109))
    assert [r.current for r in exact].count(True) == 1 and exact[4].current
    spaced = sorted((r for r in got if r.probe_id == 2), key=lambda r: r.ordinal)
    assert [r.target_ns // MS for r in spaced] == list(range(340, 621, 40)) and not spaced[0].exact
    req = spark.createDataFrame(
        [("whole", "m", 0, 10 * SECOND, 8, 4 * SECOND), ("one", "m", 0, 10, 1, 0), ("empty", "m", 5, 5, 9, 0)],
        "request_id string, media_id string, start_ns bigint, end_ns bigint, count int, probe_ns bigint",
    )
    even = {}
    for r in W.even_sample(req, frames).collect():
        even.setdefault(r.request_id, []).append(r)
    whole = sorted(even["whole"], key=lambda r: r.ordinal)
    assert len(whole) == 8 and (whole[0].target_ns, whole[-1].target_ns) == (0, 10 * SECOND)
    assert sum(r.current for r in whole) == 1
    assert [r.target_ns for r in even["one"]] == [5] and [r.target_ns for r in even["empty"]] == [5]


def test_marker_log(spark):
    schema = "media_id string, marker_id bigint, time_ns bigint, kind string, label string, category string, note string, change_seq bigint, op string"
    rows = [
        ("m", 1, 3 * SECOND, "bookmark", "a", "", "", 1, "add"), ("m", 1, 2 * SECOND, "bookmark", "b", "c", "n", 2, "update"),
        ("m", 2, 99 * SECOND, "scene", "s", "", "", 3, "add"), ("m", 3, 1, "bookmark", "x", "", "", 4, "add"), ("m", 3, 1, "bookmark", "x", "", "", 5, "remove"),
        ("m", 9, 1, "bookmark", "ghost", "", "", 6, "update"), ("m", 4, 1, "scene", "t", "", "", 7, "add"),
        ("m", None, None, "scene", None, None, None, 8, "clear"), ("m", 5, 99 * SECOND, "scene", "u", "", "", 9, "add"),
    ]
    media = spark.createDataFrame([("m", 10 * SECOND)], "media_id string, duration_ns bigint")
    got = sorted(tuple(r)[1:] for r in markers.apply_marker_changes(spark.createDataFrame(rows, schema), media).collect())
    assert got == [(1, 2 * SECOND, "bookmark", "b", "c", "n"), (5, 10 * SECOND, "scene", "u", "", "")]


def test_visit_history():
    h = VisitHistory(3)
    visit = lambda state, i: h.step(*state, "visit", (0, i, i, i * 10))
    state = ([], -1)
    for i in (0, 1, 2):
        state = visit(state, i)
    state = h.step(*state, "back", (0, -1, ABSENT, ABSENT))
    assert state[0][state[1]][1] == 1
    state = visit(state, 3)
    assert [e[1] for e in state[0]] == [0, 1, 3] and state[1] == 2
    assert h.step(*state, "forward", (0, -1, ABSENT, ABSENT))[1] == 2
    state = visit(state, 3)
    assert len(state[0]) == 3
    assert [e[1] for e in visit(state, 4)[0]] == [1, 3, 4]


def test_next_detection():
    assert next_detection(32) == 160 and next_detection(1000) == 1250
