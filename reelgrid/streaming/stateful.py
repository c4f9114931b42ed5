"""Running scene cuts, runs, level-of-detail buckets, visit history and smoothed rates with per-key state.

Detectors hold the rows of a media that others may still precede, hand over in order what lies further back
than their delay, and take a media that no row has reached for a while as complete: a timer then ends
its open runs. A row older than what has been handed over is not dropped but emitted with the kind ``late``;
``late_rows`` tells these apart for merging and detecting again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from ..config import SECOND, DetectionConfig

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = (
    "media_id string, kind string, start_ns bigint, end_ns bigint, first_frame bigint, "
    "last_frame bigint, frame_count bigint, score double"
)
_OUT_COLUMNS = [p.split()[0] for p in OUT.split(", ")]
LATE = "late"


# Whole numbers stand in for nulls on the way to pandas, where a null would turn a column of
# 64-bit values into inexact floats. Hashes travel as text for the same reason.
NO_INDEX, ABSENT = -1, -(2**63)


def _f32(value: float) -> float:
    return float(np.float32(value))


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _folded(batches: Iterable[pd.DataFrame], columns: list[str], order: list[str]) -> dict[str, np.ndarray]:
    """The named columns of all batches as arrays in order; each batch is slimmed before the next one is read."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    for batch in batches:
        for c in columns:
            held[c].append(batch[c].to_numpy())
    whole = {c: np.concatenate(v) if v else np.zeros(0) for c, v in held.items()}
    at = np.lexsort([whole[c] for c in reversed(order)])
    return {c: v[at] for c, v in whole.items()}


class _Held:
    """A named value of one key: a tuple, or a list of them."""

    def __init__(self, values: dict, name: str):
        self.values, self.name = values, name

    def exists(self) -> bool:
        return self.name in self.values

    def get(self):
        return self.values.get(self.name)

    def update(self, value) -> None:
        self.values[self.name] = value

    put = update

    def clear(self) -> None:
        self.values.pop(self.name, None)


class _HeldMap(_Held):
    def containsKey(self, key: tuple) -> bool:
        return key in self.values.get(self.name, ())

    def getValue(self, key: tuple):
        return self.values.get(self.name, {}).get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.values.setdefault(self.name, {})[key] = value

    def removeKey(self, key: tuple) -> None:
        self.values[self.name].pop(key)
        if not self.values[self.name]:
            self.clear()

    def iterator(self) -> Iterator:
        return iter(list(self.values.get(self.name, {}).items()))


class _OneKey:
    """All state and the timer of one key, which travel with its rows: a processor's reads and writes stay in memory."""

    TIMERS = "timers"

    def __init__(self, state: GroupState):
        self.state = state
        self.values = pickle.loads(state.get[0]) if state.exists else {}

    def getValueState(self, name: str, *_) -> _Held:
        return _Held(self.values, name)

    getListState = getValueState

    def getMapState(self, name: str, *_) -> _HeldMap:
        return _HeldMap(self.values, name)

    def listTimers(self) -> list[int]:
        return sorted(self.values.get(self.TIMERS, ()))

    def registerTimer(self, at: int) -> None:
        self.values[self.TIMERS] = {*self.listTimers(), at}

    def deleteTimer(self, at: int) -> None:
        self.values[self.TIMERS] = {*self.listTimers()} - {at}

    def getCurrentProcessingTimeInMs(self) -> int:
        return self.state.getCurrentProcessingTimeMs()

    def getCurrentWatermarkInMs(self) -> int:
        return self.state.getCurrentWatermarkMs()

    def write(self, by_arrival: bool) -> None:
        timers = self.listTimers()
        if not timers:
            self.values.pop(self.TIMERS, None)
        if not self.values:
            if self.state.exists:
                self.state.remove()
            return
        self.state.update((pickle.dumps(self.values),))
        if timers and by_arrival:
            self.state.setTimeoutTimestamp(timers[0])
        elif timers:
            self.state.setTimeoutDuration(max(1, timers[0] - self.getCurrentProcessingTimeInMs()))


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "None") -> DataFrame:
    """Run a processor over a stream. Rows and state of many keys travel together, so that a key costs no round trips.

    mode: None, ProcessingTime or EventTime, the clock of the processor's timers.
    """
    by_arrival = mode == "EventTime"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = _OneKey(state)
        processor.init(one)
        if state.hasTimedOut:
            for timer in one.listTimers()[:1]:
                one.deleteTimer(timer)
            yield from processor.handleExpiredTimer(key, one, None)
        else:
            yield from processor.handleInputRows(key, batches, one)
        one.write(by_arrival)

    timeout = "NoTimeout" if mode == "None" else f"{mode}Timeout"
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", timeout)


class Timed(StatefulProcessor):
    """A processor with one timer per key, renewed by every batch of rows of that key.

    With ``by_arrival`` the clock is the watermark of the arrival column, else the processing time.
    """

    def __init__(self, idle_ms: int, by_arrival: bool = False):
        self.idle_ms, self.by_arrival = max(1, idle_ms), by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _renew(self, timerValues, arrived_ms: int = 0, after_ms: int | None = None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = max(arrived_ms, timerValues.getCurrentWatermarkInMs()) if self.by_arrival else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + (self.idle_ms if after_ms is None else after_ms))

    def close(self) -> None:
        pass


class Detector(Timed):
    """Hands the rows of a media to ``take`` in order of time and frame, and calls ``finish`` when it is complete.

    delay_ns: how far back in media time a row may still come; it bounds the state of a media, beside the
    rows of the running micro-batch. idle_ms: time without rows after which a media is complete. A media that
    goes on after that starts new runs.
    """

    ROW = ["pt_ns", "frame", "end_ns", "scene_score", "duplicate_score", "content"]

    def __init__(self, config: DetectionConfig = DetectionConfig(), delay_ns: int = 10 * SECOND, idle_ms: int = 10 * 60_000, by_arrival: bool = False):
        super().__init__(idle_ms, by_arrival)
        self.config, self.delay_ns = config.normalized(), max(0, delay_ns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # Scores of -1 stand for absent ones.
        self.held = handle.getListState("held", "pt_ns bigint, frame bigint, end_ns bigint, scene_score double, duplicate_score double, content string")
        self.mark = handle.getValueState("mark", "latest_ns bigint, done_ns bigint, done_frame bigint")

    def load(self) -> None:
        """Read the detector's own state."""

    def take(self, media: str, row: tuple, out: list) -> None:
        raise NotImplementedError

    def finish(self, media: str, out: list) -> None:
        raise NotImplementedError

    def store(self) -> None:
        """Write the detector's own state."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        media, out = key[0], []
        fresh = _folded(rows, [*self.ROW, "arrived_ms"], ["pt_ns", "frame"])
        if media is None:
            return
        latest, *done = self.mark.get() if self.mark.exists() else (ABSENT, ABSENT, ABSENT)
        done = tuple(done)
        pending = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for row in zip(*(fresh[c].tolist() for c in self.ROW)):
            if row[:2] < done:
                out.append([media, LATE, row[0], row[2], row[1], row[1], 1, 0.0])
            else:
                pending.append(row)
                latest = max(latest, row[0])
        pending.sort(key=lambda r: r[:2])
        ready = sum(r[0] <= latest - self.delay_ns for r in pending)
        self.load()
        for row in pending[:ready]:
            self.take(media, row, out)
            done = row[:2]
        self.store()
        self.held.put(pending[ready:]) if pending[ready:] else self.held.clear()
        self.mark.update((latest, *done))
        self._renew(timerValues, int(fresh["arrived_ms"].max(initial=0)))
        if out:
            yield _frame(out, _OUT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        media, out = key[0], []
        latest, *done = self.mark.get() if self.mark.exists() else (ABSENT, ABSENT, ABSENT)
        self.load()
        for row in sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2]) if self.held.exists() else []:
            self.take(media, row, out)
            done = row[:2]
        self.finish(media, out)
        self.store()
        self.held.clear()
        self.mark.update((latest, *done))
        if out:
            yield _frame(out, _OUT_COLUMNS)


class RunDetector(Detector):
    """Duplicate and freeze runs: emits a run once a row breaks it or the media is complete."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "pt_ns bigint, frame bigint, content string")
        run = "kind string, start_ns bigint, first_frame bigint, end_ns bigint, last_frame bigint, total double, n bigint"
        self.runs = {"duplicate": handle.getValueState("duplicate", run), "freeze": handle.getValueState("freeze", run)}

    def load(self) -> None:
        self.before = self.last.get() if self.last.exists() else None
        self.open = {k: (s.get() if s.exists() else None) for k, s in self.runs.items()}

    def store(self) -> None:
        if self.before is not None:
            self.last.update(tuple(self.before))
        for k, state in self.runs.items():
            state.clear() if self.open[k] is None else state.update(tuple(self.open[k]))

    def _kinds(self, score: float, content: str) -> dict[str, str | None]:
        c, out = self.config, {"duplicate": None, "freeze": None}
        if score < 0 or self.before is None:
            return out
        if score >= _f32(c.near_duplicate_threshold):
            same = content != "" and self.before[2] == content
            out["duplicate"] = "exact_duplicate" if same else "near_duplicate"
        if score >= _f32(c.freeze_threshold):
            out["freeze"] = "freeze"
        return out

    def _emit(self, media: str, run, out: list) -> None:
        kind, start, first, end, last, total, n = run
        c, frames = self.config, n + 1
        if kind == "freeze":
            ok = frames >= c.freeze_frames and end - start >= c.freeze_duration_ns
        else:
            ok = frames >= c.duplicate_frames
        if ok:
            out.append([media, kind, start, max(start, end), first, last, frames, min(max(total / n, 0.0), 1.0)])

    def take(self, media: str, row: tuple, out: list) -> None:
        at, frame, end, _, score, content = row
        for k, kind in self._kinds(score, content).items():
            run = self.open[k]
            if run is not None and run[0] != kind:
                self._emit(media, run, out)
                run = None
            if kind is not None:
                if run is None:
                    run = (kind, self.before[0], self.before[1], end, frame, 0.0, 0)
                run = (*run[:3], end, frame, run[5] + score, run[6] + 1)
            self.open[k] = run
        self.before = (at, frame, content)

    def finish(self, media: str, out: list) -> None:
        for k, run in self.open.items():
            if run is not None:
                self._emit(media, run, out)
                self.open[k] = None


class SceneDetector(Detector):
    """Scene cuts with one row held back for its right neighbour and the latest scene held back
    until the minimum separation has passed, as a stronger cut may still replace it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.judging = handle.getValueState("judging", "pt_ns bigint, end_ns bigint, frame bigint, score double, before double, number bigint")
        self.scene = handle.getValueState("scene", "pt_ns bigint, end_ns bigint, frame bigint, score double")
        self.first = handle.getValueState("first", "pt_ns bigint, rows bigint")

    def load(self) -> None:
        self.row, self.latest = (s.get() if s.exists() else None for s in (self.judging, self.scene))
        self.start, self.count = self.first.get() if self.first.exists() else (None, 0)

    def store(self) -> None:
        for state, value in ((self.judging, self.row), (self.scene, self.latest)):
            state.clear() if value is None else state.update(tuple(value))
        if self.start is not None:
            self.first.update((self.start, self.count))

    def _emit(self, media: str, out: list) -> None:
        if self.latest is not None:
            at, end, frame, score = self.latest
            out.append([media, "scene", at, end, frame, frame, 1, min(max(score, 0.0), 1.0)])

    def _judge(self, media: str, after: float, out: list) -> None:
        at, end, frame, score, before, number = self.row
        if number == 0:
            self.latest = (at, end, frame, 1.0)
            return
        if score < _f32(self.config.scene_threshold) or score < max(before, 0.0) or score < max(after, 0.0):
            return
        if self.latest is None or at - self.latest[0] >= self.config.scene_separation_ns:
            self._emit(media, out)
        elif not (self.latest[3] < score and self.latest[0] != self.start):
            return
        self.latest = (at, end, frame, score)

    def take(self, media: str, row: tuple, out: list) -> None:
        at, frame, end, score, _, _ = row
        before = -1.0
        if self.row is not None:
            self._judge(media, score, out)
            # Row 1 does not look back at row 0's score.
            before = self.row[3] if self.count > 1 else -1.0
        if self.start is None:
            self.start = at
        self.row = (at, end, frame, score, before, self.count)
        self.count += 1

    def finish(self, media: str, out: list) -> None:
        if self.row is not None:
            self._judge(media, -1.0, out)
        self._emit(media, out)
        self.row = self.latest = None


def _arrived(rows: DataFrame, arrival: str | None, delay: str | None) -> tuple[DataFrame, str]:
    """Rows with ``arrived_ms``, and the time mode: by the arrival column's watermark (set before if ``delay`` is None), or by the clock."""
    if arrival is None:
        return rows.withColumn("arrived_ms", F.lit(0).cast("bigint")), "ProcessingTime"
    timed = rows if delay is None else rows.withWatermark(arrival, delay)
    return timed.withColumn("arrived_ms", F.unix_millis(arrival)), "EventTime"


def detect_stream(samples: DataFrame, processor: Detector, arrival: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Apply a detector to a stream of samples in any order within its delay; rows of kind ``late`` tell the others.

    ``arrival``: a timestamp column that drives the timers, for a processor made with ``by_arrival``;
    rows without media only move it on. Without it timers follow the processing time.
    """
    timed, mode = _arrived(samples, arrival, delay)
    score = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)
    # In an arrival whose media is null every other column may be.
    rows = timed.select(
        "media_id", F.coalesce("pt_ns", F.lit(0)).alias("pt_ns"), F.coalesce("presentation_index", F.lit(NO_INDEX)).alias("frame"),
        (F.coalesce("pt_ns", F.lit(0)) + F.greatest(F.coalesce("duration_ns", F.lit(0)), F.lit(1))).alias("end_ns"),
        score("scene_score"), score("duplicate_score"), F.coalesce(F.col("content_hash").cast("string"), F.lit("")).alias("content"),
        "arrived_ms", *([arrival] if arrival else []),
    )
    out = stateful(rows, ["media_id"], processor, OUT, mode)
    known = {c: F.when(F.col(c) != NO_INDEX, F.col(c)) for c in ("first_frame", "last_frame")}
    return out.withColumns(known)


def late_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections, late rows by media, time and frame) of what ``detect_stream`` emitted."""
    late = found.where(F.col("kind") == LATE).select("media_id", F.col("start_ns").alias("pt_ns"), F.col("first_frame").alias("presentation_index"))
    return found.where(F.col("kind") != LATE), late


class Identities(Timed):
    """Rows of one media, time and stream timestamp: an indexed row passes, others wait whether one comes.

    Indexed rows are told apart by index before. A row without an index is the indexed one's when there is
    one, else the first of its kind; it is emitted when ``idle_ms`` have passed without one. What has been
    seen is forgotten ``keep_ms`` after its last row.
    """

    def __init__(self, idle_ms: int = 10_000, keep_ms: int = 600_000, by_arrival: bool = False):
        super().__init__(idle_ms, by_arrival)
        self.keep_ms = max(1, keep_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "indexed boolean, n bigint")
        self.waiting = handle.getValueState("waiting", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _folded(rows, ["indexed", "body", "arrived_ms"], ["body"])
        if key[0] is None:
            return
        indexed, n = self.told.get() if self.told.exists() else (False, 0)
        known = fresh["indexed"].astype(bool)
        passed = fresh["body"][known].tolist()
        if passed:
            self.waiting.clear()
        elif not indexed and n == 0 and len(known):
            self.waiting.update((fresh["body"][0],))
        self.told.update((indexed or bool(passed), n + len(known)))
        self._renew(timerValues, int(fresh["arrived_ms"].max(initial=0)), self.idle_ms if self.waiting.exists() else self.keep_ms)
        if passed:
            yield _frame([[b] for b in passed], ["body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            body = self.waiting.get()[0]
            self.waiting.clear()
            self._renew(timerValues, after_ms=self.keep_ms)
            yield _frame([[body]], ["body"])
        else:
            self.told.clear()


# The format in which rows wait as text; microseconds are kept.
TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}


def distinct_identities(
    samples: DataFrame, arrival: str | None = None, delay: str | None = "10 minutes", wait_ms: int = 10_000, keep_ms: int = 600_000
) -> DataFrame:
    """Samples of a stream once per identity: by index, else by time and stream timestamp where no indexed row has them.

    Rows without an index wait ``wait_ms`` for an indexed one. Keys are single identities, so a media with
    most of the rows is spread like the others.
    """
    columns = [c for c in samples.columns if c != arrival]
    timed, mode = _arrived(samples, arrival, delay)
    body = F.to_json(F.struct(*columns), TEXT)
    rows = timed.select(
        "media_id", F.coalesce("pt_ns", F.lit(ABSENT)).alias("pt_ns"), F.coalesce("pts", F.lit(ABSENT)).alias("pts"),
        F.coalesce(F.col("presentation_index") >= 0, F.lit(False)).alias("indexed"), body.alias("body"), "arrived_ms", *([arrival] if arrival else []),
    )
    processor = Identities(wait_ms, keep_ms, arrival is not None)
    out = stateful(rows, ["media_id", "pt_ns", "pts"], processor, "body string", mode)
    return out.select(F.from_json("body", samples.select(*columns).schema, TEXT).alias("row")).select("row.*")


class ClosingBuckets(Timed):
    """Sums of level-of-detail buckets per media, each emitted once its media is past it by ``delay_ns``, or idle.

    A media progresses by its own latest time, whatever others do. Sums of rows behind the closed part are
    emitted at once, marked late: sums, minima and maxima of a bucket merge with those emitted before.
    """

    def __init__(self, schema: str, delay_ns: int, idle_ms: int, by_arrival: bool = False):
        super().__init__(idle_ms, by_arrival)
        self.schema, self.delay_ns = schema, max(0, delay_ns)
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        body = [c for c in self.schema.split(", ") if c.split()[0] not in ("media_id", "bucket", "late")]
        self.values = [c.split()[0] for c in body]
        self.sums = handle.getMapState("sums", "bucket bigint", ", ".join(["end_ns bigint", *body]))
        self.mark = handle.getValueState("mark", "latest_ns bigint, closed_ns bigint")

    def _merge(self, a: tuple, b: tuple) -> tuple:
        out = []
        for name, x, y in zip(self.values, a, b):
            if x is None or y is None:
                out.append(y if x is None else x)
            else:
                out.append(min(x, y) if name.endswith("_min") else max(x, y) if name.endswith("_max") else x + y)
        return tuple(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        media, out, open_ = key[0], [], {}
        fresh = _folded(rows, ["bucket", "end_ns", "top_ns", *self.values, "arrived_ms"], ["bucket"])
        if media is None:
            return
        latest, closed = self.mark.get() if self.mark.exists() else (ABSENT, ABSENT)
        plain = lambda v: None if v is None or v != v else v
        for bucket, end, *body in zip(*(fresh[c].tolist() for c in ("bucket", "end_ns", *self.values))):
            body = tuple(map(plain, body))
            known = open_.get(bucket)
            open_[bucket] = (end, *(self._merge(known[1:], body) if known else body))
        latest = max(latest, int(fresh["top_ns"].max(initial=ABSENT)))
        horizon = max(closed, latest - self.delay_ns)
        for bucket, (end, *body) in open_.items():
            if end <= closed:
                out.append([media, bucket, *body, True])
            else:
                known = self.sums.getValue((bucket,)) if self.sums.containsKey((bucket,)) else None
                self.sums.updateValue((bucket,), (end, *(self._merge(tuple(known)[1:], tuple(body)) if known is not None else body)))
        out += self._close(media, horizon)
        self.mark.update((latest, horizon))
        self._renew(timerValues, int(fresh["arrived_ms"].max(initial=0)))
        if out:
            yield _frame(out, self.columns)

    def _close(self, media: str, horizon: int) -> list:
        past = [(k[0], tuple(v)) for k, v in self.sums.iterator() if v[0] <= horizon]
        for bucket, _ in past:
            self.sums.removeKey((bucket,))
        return [[media, bucket, *values[1:], False] for bucket, values in past]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The media is complete: all its buckets close. One that gets rows afterwards closes again with those."""
        out = self._close(key[0], 2**63 - 1)
        if out:
            yield _frame(out, self.columns)


class VisitHistory(StatefulProcessor):
    """Back/forward history per user: a visit drops the forward branch, repeats are ignored.

    Emits the position after every action: entries, current position and current frame.
    """

    SCHEMA = (
        "user_id string, seq bigint, action string, entries bigint, position bigint, "
        "presentation_index bigint, pt_ns bigint, can_back boolean, can_forward boolean"
    )

    def __init__(self, keep: int = 128):
        self.keep = max(1, keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        item = "struct<serial:bigint,presentation_index:bigint,pts:bigint,pt_ns:bigint>"
        self.state = handle.getValueState("history", f"entries array<{item}>, position bigint")

    @staticmethod
    def _same(a, b) -> bool:
        if a[0] and a[0] == b[0]:
            return True
        if a[1] >= 0 and b[1] >= 0:
            return a[1] == b[1]
        return a[3] == b[3] and a[2] == b[2]

    def step(self, entries: list, position: int, action: str, item) -> tuple[list, int]:
        if action == "visit":
            if item[3] == ABSENT:
                return entries, position
            if position >= 0 and self._same(entries[position], item):
                entries[position] = item
                return entries, position
            entries = (entries[: position + 1] + [item])[-self.keep :]
            return entries, len(entries) - 1
        if action == "back" and position > 0:
            return entries, position - 1
        if action == "forward" and 0 <= position < len(entries) - 1:
            return entries, position + 1
        return entries, position

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entries, position = [], -1
        if self.state.exists():
            stored = self.state.get()
            entries, position = [tuple(e) for e in stored[0]], int(stored[1])
        out = []
        columns = ["seq", "action", "serial", "presentation_index", "pts", "pt_ns"]
        fresh = _folded(rows, columns, ["seq"])
        for seq, action, *item in zip(*(fresh[c].tolist() for c in columns)):
            entries, position = self.step(entries, position, action, tuple(item))
            now = entries[position] if position >= 0 else (0, NO_INDEX, ABSENT, ABSENT)
            forward = 0 <= position < len(entries) - 1
            out.append([key[0], seq, action, len(entries), position, now[1], now[3], position > 0, forward])
        self.state.update((entries, position))
        yield _frame(out, [p.split()[0] for p in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def visit_history(visits: DataFrame, keep: int = 128) -> DataFrame:
    whole = lambda c, absent: F.coalesce(c, F.lit(absent)).cast("bigint").alias(c)
    rows = visits.select(
        "user_id", "seq", "action", whole("serial", 0), whole("presentation_index", NO_INDEX), whole("pts", ABSENT), whole("pt_ns", ABSENT)
    )
    return stateful(rows, ["user_id"], VisitHistory(keep), VisitHistory.SCHEMA)


class DecodeRate(StatefulProcessor):
    """Smoothed rate per session, 0.85 old + 0.15 new."""

    SCHEMA = "session_id string, seq bigint, rate double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "rate double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rate = self.state.get()[0] if self.state.exists() else 0.0
        out = []
        fresh = _folded(rows, ["seq", "seconds"], ["seq"])
        for seq, seconds in zip(fresh["seq"].tolist(), fresh["seconds"].tolist()):
            if seconds > 0:
                now = 1.0 / seconds
                rate = now if rate == 0.0 else rate * 0.85 + now * 0.15
                out.append([key[0], seq, rate])
        self.state.update((rate,))
        if out:
            yield _frame(out, ["session_id", "seq", "rate"])

    def close(self) -> None:
        pass


def decode_rate_stream(log: DataFrame) -> DataFrame:
    return stateful(log, ["session_id"], DecodeRate(), DecodeRate.SCHEMA)
