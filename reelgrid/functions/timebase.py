"""Exact nanosecond timeline arithmetic on BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SECOND

INT64_MAX = 2**63 - 1
INT64_MIN = -(2**63)
BIG = "decimal(38,0)"


def _big(value: Column) -> Column:
    return value.cast(BIG)


def _rescale(value: Column, mul: Column, div: Column) -> Column:
    """value * mul / div, halves away from zero, in decimal(38,0).

    The result range is compared in decimals before the division, because decimal integral
    division returns a BIGINT. The extreme inputs pass through; a result that does not fit
    becomes the lowest valid time.
    """
    scaled = F.abs(_big(value)) * mul
    doubled = (scaled * 2 + div).cast(BIG)
    fits = doubled < (div * 2).cast(BIG) * F.lit(str(2**63)).cast(BIG)
    # The divisor is at most 2**31 * 1e9 * 2; the quotient is a BIGINT once it is known to fit.
    safe = F.when(fits, doubled).otherwise(F.lit(0).cast(BIG))
    quotient = F.call_function("div", safe, (div * 2).cast(BIG))
    signed = F.when(value < 0, -quotient).otherwise(quotient)
    exact = F.when(fits, signed).otherwise(F.lit(INT64_MIN + 1))
    return F.when(value == INT64_MAX, value).otherwise(exact)


def _saturate(total: Column, low: int, high: int) -> Column:
    return F.when(total > F.lit(high).cast(BIG), F.lit(high)).when(
        total < F.lit(low).cast(BIG), F.lit(low)
    ).otherwise(total.cast("bigint"))


def _valid_base(base: Column) -> Column:
    return (base["num"] > 0) & (base["den"] > 0)


def pts_to_ns(ts: Column, origin: Column, base: Column) -> Column:
    """Stream timestamp to nanoseconds from the stream origin; null on a missing part."""
    gap = _big(ts) - _big(origin)
    # One step inside the limits, as the outermost value stands for "absent".
    relative = (
        F.when(gap < F.lit(INT64_MIN).cast(BIG), F.lit(INT64_MIN + 1))
        .when(gap > F.lit(INT64_MAX).cast(BIG), F.lit(INT64_MAX - 1))
        .otherwise(gap.cast("bigint"))
    )
    ns = _rescale(relative, _big(base["num"]) * F.lit(SECOND).cast(BIG), _big(base["den"]))
    return F.when(ts.isNotNull() & origin.isNotNull() & _valid_base(base), ns)


def ns_to_pts(ns: Column, origin: Column, base: Column) -> Column:
    """Inverse of :func:`pts_to_ns`."""
    relative = _rescale(ns, _big(base["den"]), _big(base["num"]) * F.lit(SECOND).cast(BIG))
    pts = _saturate(_big(origin) + _big(relative), INT64_MIN + 1, INT64_MAX)
    return F.when(ns.isNotNull() & origin.isNotNull() & _valid_base(base), pts)


def nominal_frame_duration(rate: Column) -> Column:
    """Nanoseconds per frame of a num/den rate, 0 for an invalid rate."""
    ns = _rescale(F.lit(1).cast("bigint"), _big(rate["den"]) * F.lit(SECOND).cast(BIG), _big(rate["num"]))
    valid = F.coalesce((rate["num"] > 0) & (rate["den"] > 0), F.lit(False))
    return F.when(valid, F.greatest(ns, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def clamp_time(time: Column, duration: Column) -> Column:
    """Time inside [0, duration]; an absent or non-positive duration bounds below only."""
    low = F.greatest(F.coalesce(time, F.lit(0)), F.lit(0)).cast("bigint")
    return F.when(duration > 0, F.least(low, duration)).otherwise(low)


def ordered_range(a: Column, b: Column, duration: Column) -> tuple[Column, Column]:
    """(start, end) of two range ends given in any order."""
    x, y = clamp_time(a, duration), clamp_time(b, duration)
    return F.least(x, y), F.greatest(x, y)


def frame_end(time: Column, duration: Column) -> Column:
    return time + F.greatest(duration, F.lit(1))


def format_timestamp(ns: Column) -> Column:
    """HH:MM:SS.mmm, truncated; negative times show as zero."""
    ms = F.greatest(F.call_function("div", ns, F.lit(1_000_000)), F.lit(0))
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.call_function("div", ms, F.lit(3_600_000)),
        F.call_function("div", ms, F.lit(60_000)) % 60,
        F.call_function("div", ms, F.lit(1000)) % 60,
        ms % 1000,
    )
