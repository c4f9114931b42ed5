"""State travels with the rows of a key: a key costs no round trips to the state store."""

from reelgrid.config import DetectionConfig
from reelgrid.schemas import SCHEMAS
from reelgrid.streaming import progressive as P
from reelgrid.streaming import stateful as S
from reelgrid.streaming.replay import replay
from test_detect import COLS, row


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def arriving(spark, tmp_path):
    schema = SCHEMAS["samples"] + ", arrived timestamp"
    return spark.readStream.schema(schema).parquet(str(tmp_path))


def test_no_operator_asks_the_store_key_by_key(spark, tmp_path):
    rows = arriving(spark, tmp_path)
    detected = S.detect_stream(rows, S.RunDetector(DetectionConfig(), by_arrival=True), "arrived")
    geometry = spark.createDataFrame([("m", 10, 5, 2)], "media_id string, duration_ns bigint, span_ns bigint, buckets bigint")
    once = P.dedup_stream(rows, "1 hour", 1000, "arrived")
    for df in (detected, P.closed_lod(rows, geometry, arrival="arrived"), once):
        assert "TransformWithState" not in analysed(df)
    assert "Pandas" not in analysed(once)


def test_rows_without_index_wait_by_arrival(spark):
    schema = SCHEMAS["samples"] + ", arrived long"

    def part(hour, *rows):
        made = [(*[r[c] for c in COLS], 946_684_800 + hour * 3600) for r in rows]
        df = spark.createDataFrame(made, schema)
        return df.withColumn("arrived", df.arrived.cast("timestamp"))

    bare = lambda t, media="m": row(media, None, t) | {"pts": t}
    full = lambda i, t, media="m": row(media, i, t) | {"pts": t}
    parts = [
        part(0, bare(1), full(2, 2), bare(3), bare(3), full(9, 9)),
        part(1, bare(1), bare(2), full(3, 3), full(2, 2)),  # 2 came before its bare row, 3 comes after
        part(2, bare(4, "n"), full(9, 9)),
        part(900, {**bare(0), "media_id": None, "pt_ns": None, "pts": None}),
    ]
    out = replay(parts, lambda r: P.dedup_stream(r, "10 hours", 7_200_000, "arrived")).collect()
    assert sorted((r.media_id, r.presentation_index or -1, r.pt_ns) for r in out) == [
        ("m", -1, 1), ("m", 2, 2), ("m", 3, 3), ("m", 9, 9), ("n", -1, 4)
    ]


def test_one_key_keeps_state_and_the_next_timer():
    class State:
        exists, get, timeout, removed = False, None, None, False

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.removed = False, True

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    state = State()
    one = S._OneKey(state)
    sums, mark = one.getMapState("sums", "", ""), one.getValueState("mark", "")
    sums.updateValue((1,), (2, None))
    mark.update((5,))
    one.registerTimer(70)
    one.registerTimer(60)
    one.write(True)
    again = S._OneKey(state)
    assert state.timeout == 60 and again.listTimers() == [60, 70]
    assert list(again.getMapState("sums").iterator()) == [((1,), (2, None))] and again.getValueState("mark").get() == (5,)
    again.getMapState("sums").removeKey((1,))
    again.getValueState("mark").clear()
    for timer in again.listTimers():
        again.deleteTimer(timer)
    again.write(True)
    assert state.removed
