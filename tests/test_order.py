import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.order import CHUNK, arrange, carry_last, running_sum, sequence, trailing


def make_rows(seed, groups=3, size=40):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        n = size if g else size * 3
        for i in range(n):
            t = rng.choice([rng.randrange(50), rng.randrange(5000)])
            rows.append((f"m{g}", t, i, i, rng.choice([None, rng.randrange(100)])))
    rng.shuffle(rows)
    return rows


def model(rows):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g, rs in groups.items():
        rs.sort(key=lambda r: (r[1], r[2], r[3]))
        last, total, after = None, 0, [None] * len(rs)
        nxt = None
        for i in range(len(rs) - 1, -1, -1):
            after[i] = nxt
            nxt = rs[i][4] if rs[i][4] is not None else nxt
        for i, r in enumerate(rs):
            before = last
            last = r[4] if r[4] is not None else last
            total += r[4] or 0
            out[(g, r[2])] = (
                i,
                rs[i - 1][2] if i else None,
                rs[i + 1][2] if i + 1 < len(rs) else None,
                last,
                before,
                after[i],
                total,
                [x[2] for x in rs[max(0, i - 5):i]],
            )
    return out


@pytest.mark.parametrize("limit", [10_000, 50, 7])
def test_windows_equal_model(spark, limit):
    rows = make_rows(limit)
    df = spark.createDataFrame(
        rows, "media_id string, pt_ns bigint, presentation_index bigint, pts bigint, v bigint"
    )
    o = arrange(df, rows_per_chunk=limit)
    assert o.split == (limit < 120)
    if o.split:
        assert o.df.select("media_id", CHUNK).distinct().count() > 3
    o = sequence(o, ["presentation_index"], prev=True, next=True)
    o = carry_last(o, F.col("v"), "last_v")
    o = carry_last(o, F.col("v"), "before_v", inclusive=False)
    o = carry_last(o, F.col("v"), "after_v", inclusive=False, reverse=True)
    o = running_sum(o, F.col("v"), "total")
    o = trailing(o, F.col("presentation_index"), 5, "trail")
    got = {
        (r.media_id, r.presentation_index): (
            r._pos,
            r._prev and r._prev.presentation_index,
            r._next and r._next.presentation_index,
            r.last_v,
            r.before_v,
            r.after_v,
            r.total,
            list(r.trail),
        )
        for r in o.df.collect()
    }
    want = model(rows)
    # 0 is a valid neighbour index, so compare with None kept apart
    for key, value in want.items():
        assert got[key][3:] == value[3:], key
        assert (got[key][0], got[key][1], got[key][2]) == value[:3], key
