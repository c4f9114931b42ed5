import random

import pytest

import models
from reelgrid.config import MS, SECOND, DetectionConfig
from reelgrid.operators.detect import detect, prepare, repeated_sections
from reelgrid.operators.order import arrange
from reelgrid.schemas import SCHEMAS

COLS = [c.split()[0] for c in SCHEMAS["samples"].split(", ")]


def row(media, i, t, **kw):
    base = dict(
        media_id=media, presentation_index=i, pts=i, pt_ns=t, duration_ns=0, key_frame=False, motion=None,
        similarity=None, scene_score=None, duplicate_score=None, content_hash=None, perceptual_hash=None,
        ingest_seq=0,
    )
    base.update(kw)
    return base


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLS) for r in rows], SCHEMAS["samples"])


def test_scene_duplicate_and_freeze_case(spark):
    rows = [
        row("m", i, i * 100 * MS, duration_ns=100 * MS, scene_score=0.05, duplicate_score=0.2,
            content_hash=i + 1, perceptual_hash=i + 1)
        for i in range(10)
    ]
    rows[3]["scene_score"], rows[4]["scene_score"] = 0.85, 0.60
    for i in range(4):
        rows[i]["content_hash"] = rows[i]["perceptual_hash"] = 77
        if i:
            rows[i]["duplicate_score"] = 1.0
    for i in (4, 5, 6):
        rows[i]["duplicate_score"] = 0.99
    cfg = DetectionConfig(
        scene_threshold=0.5, scene_separation_ns=200 * MS, near_duplicate_threshold=0.98,
        freeze_duration_ns=300 * MS, repeated_separation_ns=10 * SECOND,
    )
    got = {}
    for r in detect(frame(spark, rows), cfg).collect():
        got.setdefault(r.kind, []).append(r)
    assert sorted(r.first_frame for r in got["scene"]) == [0, 3]
    assert [(r.first_frame, r.last_frame) for r in got["exact_duplicate"]] == [(0, 3)]
    assert [(r.first_frame, r.last_frame) for r in got["near_duplicate"]] == [(3, 6)]
    assert [r.frame_count for r in got["freeze"]] == [4]


def test_repeated_section_case(spark):
    hashes = [11, 22, 33, 90, 91, 92, 11, 22, 33]
    rows = [row("m", i, i * 100 * MS, duration_ns=100 * MS, perceptual_hash=h) for i, h in enumerate(hashes)]
    cfg = DetectionConfig(repeated_frames=3, repeated_separation_ns=500 * MS, results_per_kind=4)
    r = repeated_sections(prepare(frame(spark, rows)), cfg).collect()
    assert [(x.first_frame, x.last_frame, x.match_first_frame, x.match_last_frame) for x in r] == [(6, 8, 0, 2)]


def random_media(rng, media, n):
    rows, t = [], 0
    pool = [rng.getrandbits(63) for _ in range(4)]
    for i in range(n):
        t += rng.choice([0, 40, 40, 40, 120]) * MS
        h = rng.choice(pool)
        if rng.random() < 0.4:
            h ^= 1 << rng.randrange(60)
        if i > 20 and rng.random() < 0.7:
            h = rows[i - 20]["perceptual_hash"]
        pick = lambda *v: None if rng.random() < 0.1 else rng.choice(v)
        rows.append(row(
            media, i, t, duration_ns=rng.choice([0, 40 * MS]), scene_score=pick(0.1, 0.45, 0.5, 0.5, 0.9),
            duplicate_score=pick(0.2, 0.985, 0.99, 0.995, 1.0), content_hash=pick(1, 1, 2),
            perceptual_hash=None if rng.random() < 0.05 else h,
        ))
    return rows


@pytest.mark.parametrize("limit,cap", [(10_000, None), (10_000, 3), (25, None)])
def test_detections_equal_model(spark, limit, cap):
    rng = random.Random(limit + (cap or 0))
    media = {f"m{k}": random_media(rng, f"m{k}", n) for k, n in enumerate([1, 2, 60, 150])}
    rows = [r for rs in media.values() for r in rs]
    rng.shuffle(rows)
    cfg = DetectionConfig(
        scene_separation_ns=250 * MS, freeze_duration_ns=60 * MS, repeated_separation_ns=200 * MS,
        results_per_kind=cap,
    )
    spark.conf.set("reelgrid.chunk.rows", str(limit))
    try:
        o = arrange(frame(spark, rows))
        assert o.split == (limit < 150)
        got = {}
        for r in detect(o, cfg).collect():
            item = (r.kind, r.start_ns, r.end_ns, r.first_frame, r.last_frame, r.frame_count)
            if r.kind == "repeated_section":
                item += (r.match_start_ns, r.match_last_frame)
            got.setdefault(r.media_id, []).append(item)
    finally:
        spark.conf.unset("reelgrid.chunk.rows")
    for m, rs in media.items():
        dup = models.duplicates(rs, cfg)
        want = models.scenes(rs, cfg) + dup + models.freezes(rs, cfg) + models.repeated(rs, cfg, len(dup))
        assert sorted(got.get(m, []), key=str) == sorted(want, key=str), m
