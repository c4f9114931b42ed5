"""Stateful processors over state held in memory: order, late rows, timers, identities and closing buckets."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from reelgrid.config import DetectionConfig
from reelgrid.streaming import stateful as S
from reelgrid.streaming.progressive import CLOSED


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(value)

    put = update

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = tuple(value)

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers = set()

    getValueState = getListState = lambda self, *a, **k: Value()
    getMapState = lambda self, *a, **k: Map()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def clock(now):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now, getCurrentWatermarkInMs=lambda: now)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def samples(rows):
    columns = ["pt_ns", "frame", "end_ns", "scene_score", "duplicate_score", "content", "arrived_ms"]
    return pd.DataFrame([(t, f, t + 1, s, d, c, 0) for t, f, s, d, c in rows], columns=columns)


def fed(processor, batches, now=0):
    out = []
    for k, rows in enumerate(batches):
        # A micro-batch comes as several frames.
        frames = [samples(rows[i::2]) for i in range(2) if rows[i::2]]
        for got in processor.handleInputRows(("m",), iter(frames), clock(now + k)):
            out += got.values.tolist()
    return out


def ended(processor, handle):
    out = []
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
        for got in processor.handleExpiredTimer(("m",), clock(timer), None):
            out += got.values.tolist()
    return out


CONFIG = DetectionConfig(scene_separation_ns=30, freeze_duration_ns=0, freeze_frames=3)


def media(n=60, seed=0):
    rng = random.Random(seed)
    return [(10 * i, i, rng.choice([0.1, 0.5, 0.9]), -1.0 if i == 0 else rng.choice([0.2, 0.99, 1.0]), rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("kind", [S.RunDetector, S.SceneDetector])
@pytest.mark.parametrize("seed", range(5))
def test_any_order_within_the_delay_gives_the_same(kind, seed):
    rows = media(seed=seed)
    whole = kind(CONFIG, 0)
    handle = started(whole)
    want = fed(whole, [rows]) + ended(whole, handle)
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r[1] + rng.randrange(6))
    parts = kind(CONFIG, 60)
    handle = started(parts)
    got = fed(parts, [moved[i : i + 7] for i in range(0, len(moved), 7)]) + ended(parts, handle)
    assert got == want and all(r[1] != S.LATE for r in got)


def test_rows_behind_the_delay_are_told():
    rows = media()
    detector = S.RunDetector(CONFIG, 50)
    handle = started(detector)
    out = fed(detector, [rows[:5] + rows[7:40], [rows[5]], rows[40:]]) + ended(detector, handle)
    assert [r[:6] for r in out if r[1] == S.LATE] == [["m", S.LATE, 50, 51, 5, 5]]


def test_each_batch_renews_the_only_timer():
    detector = S.SceneDetector(CONFIG, 0, idle_ms=100)
    handle = started(detector)
    fed(detector, [media(5), media(6)[5:]], now=7)
    assert list(handle.listTimers()) == [108]
    by_arrival = S.SceneDetector(CONFIG, 0, idle_ms=100, by_arrival=True)
    handle = started(by_arrival)
    fed(by_arrival, [media(5)], now=3)
    assert list(handle.listTimers()) == [103]


def test_a_media_that_goes_on_after_its_end_starts_anew():
    detector = S.RunDetector(CONFIG, 0)
    handle = started(detector)
    still = [(10 * i, i, 0.0, -1.0 if i == 0 else 1.0, "a") for i in range(9)]
    first = fed(detector, [still[:5]]) + ended(detector, handle)
    second = fed(detector, [still[5:]]) + ended(detector, handle)
    assert [(r[1], r[4], r[5]) for r in first] == [("exact_duplicate", 0, 4), ("freeze", 0, 4)]
    assert [(r[1], r[4], r[5]) for r in second] == [("exact_duplicate", 4, 8), ("freeze", 4, 8)]


def identities(*batches, end=True):
    processor = S.Identities(idle_ms=10, keep_ms=50)
    handle, out = started(processor), []
    for k, rows in enumerate(batches):
        frame = pd.DataFrame([(known, body, 0) for known, body in rows], columns=["indexed", "body", "arrived_ms"])
        for got in processor.handleInputRows(("m", 5, 6), iter([frame]), clock(k)):
            out += got["body"].tolist()
    return out + ([r[0] for r in ended(processor, handle)] if end else []), processor, handle


def test_a_row_without_index_waits_for_an_indexed_one():
    assert identities([(False, "x"), (False, "y")])[0] == ["x"]
    assert identities([(False, "x")], end=False)[0] == []
    assert identities([(False, "x")], [(True, "i")])[0] == ["i"]
    assert identities([(True, "i")], [(False, "x")])[0] == ["i"]
    assert identities([(True, "i"), (True, "j"), (False, "x")])[0] == ["i", "j"]


def test_what_was_seen_is_forgotten_later():
    _, processor, handle = identities([(False, "x")])
    assert processor.told.exists() and list(handle.listTimers()) == [60]
    ended(processor, handle)
    assert not processor.told.exists() and not handle.timers


def test_buckets_close_by_their_own_media_and_late_rows_are_sums_as_well():
    processor = S.ClosingBuckets(CLOSED, delay_ns=10, idle_ms=10)
    handle = started(processor)
    names = ["bucket", "end_ns", "top_ns", *processor.values, "arrived_ms"]

    def feed(*rows):
        body = lambda n, v: [n, n, v * n, v, v] * 1 + [0, 0.0, float("nan"), float("nan")] * 2
        frame = pd.DataFrame([[b, 100 * (b + 1), top, *body(n, v), 0] for b, top, n, v in rows], columns=names)
        return [r for got in processor.handleInputRows(("m",), iter([frame]), clock(0)) for r in got.values.tolist()]

    assert feed((0, 90, 2, 0.5), (0, 95, 1, 1.0)) == []
    (closed,) = feed((1, 111, 1, 0.25))
    assert closed[1:7] == [0, 3, 3, 2.0, 0.5, 1.0] and closed[-1] is False
    (late,) = feed((0, 50, 1, 0.125))
    assert late[1:5] == [0, 1, 1, 0.125] and late[-1] is True
    (last,) = ended(processor, handle)
    assert last[1:5] == [1, 1, 1, 0.25] and processor.sums.held == {}
