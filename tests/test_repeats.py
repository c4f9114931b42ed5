"""Repeated sections of media that fit one task, and of both kinds at once."""

import random

import numpy as np
import pytest

import models
from reelgrid.config import MS, DetectionConfig
from reelgrid.operators import detect as D
from reelgrid.operators import repeats as R
from test_detect import frame, random_media

CONFIG = DetectionConfig(repeated_frames=2, repeated_separation_ns=200 * MS, perceptual_distance=4, fingerprint_candidates=3)


def found(spark, media, cfg):
    got = D.repeated_sections(D.prepare(frame(spark, [r for rs in media.values() for r in rs])), cfg).collect()
    return sorted((r.media_id, r.start_ns, r.end_ns, r.first_frame, r.last_frame, r.match_start_ns, r.match_last_frame) for r in got)


def wanted(media, cfg):
    return sorted((m, *r[1:5], *r[6:]) for m, rs in media.items() for r in models.repeated(rs, cfg, 0))


def test_seeds_of_small_media_are_no_rows(spark, monkeypatch):
    """Eight seeds per row with their diagonals filled the disk."""
    rng = random.Random(5)
    media = {f"m{k}": random_media(rng, f"m{k}", n) for k, n in enumerate([1, 3, 90, 140])}
    want = wanted(media, CONFIG)
    monkeypatch.setattr(D, "seed_lengths", lambda *a, **k: pytest.fail("seeds as rows"))
    assert want and found(spark, media, CONFIG) == want


def test_small_and_large_media_together(spark, monkeypatch):
    rng = random.Random(6)
    media = {f"m{k}": random_media(rng, f"m{k}", n) for k, n in enumerate([2, 60, 150])}
    monkeypatch.setattr(D, "ROWS_AT_ONCE", 100)
    assert found(spark, media, CONFIG) == wanted(media, CONFIG)


@pytest.mark.parametrize("seed", range(4))
def test_best_matches_equal_every_pair(seed):
    rng = np.random.default_rng(seed)
    sizes = [1, 40, 7, 80]
    begin = np.cumsum([0, *sizes[:-1]])
    first, stop = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
    n = len(first)
    hashes, known, times = rng.integers(0, 4, n) * (1 + seed * 6), rng.random(n) > 0.1, np.arange(n) * 100 * MS
    want = {}
    for i in range(n):
        same = [j for j in range(first[i], i) if known[i] and known[j] and hashes[i] == hashes[j]][-3:]
        for j in (j for j in same if times[i] - times[j] >= CONFIG.repeated_separation_ns):
            length = total = 0
            while length < i - j and i + length < stop[i]:
                a, b = i + length, j + length
                d = int(hashes[a] ^ hashes[b]).bit_count()
                if not (known[a] and known[b] and d <= CONFIG.perceptual_distance):
                    break
                length, total = length + 1, total + d
            if length >= 2:
                want[i] = max(want.get(i, (0,)), (length, float(np.float32((length - total / 64) / length)), j))
    got = R.best_matches(first, stop, hashes, known, times, CONFIG)
    assert {int(a): (int(b), float(c), int(d)) for a, b, c, d in zip(*got)} == want
