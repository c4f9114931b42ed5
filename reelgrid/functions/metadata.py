"""Frame and media metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALGORITHM_VERSION, SCHEMA_VERSION

# Codes of the coded picture types.
PICTURE_TYPES = {0: "None", 1: "I", 2: "P", 3: "B", 4: "S", 5: "SI", 6: "SP", 7: "BI"}

COLOR_FIELDS = ("range", "matrix", "primaries", "transfer")


def picture_type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PICTURE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("Unknown"))


def presentation_timestamp(best_effort: Column, pts: Column, dts: Column) -> Column:
    return F.coalesce(best_effort, pts, dts)


def identity_pts(best_effort: Column, pts: Column) -> Column:
    return F.coalesce(pts, best_effort)


def declared_duration(duration: Column) -> Column:
    """A frame's own duration where positive, else 0."""
    return F.when(duration > 0, duration).otherwise(F.lit(0).cast("bigint"))


def or_stream(value: Column, stream_value: Column, unspecified: str = "unspecified") -> Column:
    return F.coalesce(F.nullif(value, F.lit(unspecified)), stream_value)


def color_or_stream(color: Column, stream_color: Column) -> Column:
    return F.struct(
        *[or_stream(color[f], stream_color[f]).alias(f) for f in COLOR_FIELDS]
    )


def bit_depth_or_stream(depth: Column, stream_depth: Column) -> Column:
    return F.when(depth > 0, depth).otherwise(stream_depth)


def rational_value(r: Column) -> Column:
    """num/den as a double, null for a zero denominator."""
    return F.when(r["den"] != 0, r["num"].cast("double") / r["den"].cast("double"))


def _point(p: Column) -> Column:
    x, y = rational_value(p["x"]), rational_value(p["y"])
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def mastering_display(raw: Column) -> Column:
    """Mastering display struct of raw rationals.

    Primaries need all four points, luminance both ends; nothing at all gives null.
    """
    points = {name: _point(raw["primaries"][name]) for name in ("red", "green", "blue", "white")}
    complete = raw["has_primaries"]
    for point in points.values():
        complete = complete & point.isNotNull()
    primaries = F.when(complete, F.struct(*[p.alias(n) for n, p in points.items()]))
    low, high = rational_value(raw["luminance"]["min"]), rational_value(raw["luminance"]["max"])
    luminance = F.when(
        raw["has_luminance"] & low.isNotNull() & high.isNotNull(),
        F.struct(low.alias("min"), high.alias("max")),
    )
    return F.when(
        primaries.isNotNull() | luminance.isNotNull(),
        F.struct(primaries.alias("primaries"), luminance.alias("luminance")),
    )


def content_light(max_cll: Column, max_fall: Column) -> Column:
    return F.when(
        max_cll.isNotNull() & max_fall.isNotNull(),
        F.struct(max_cll.cast("int").alias("max_cll"), max_fall.cast("int").alias("max_fall")),
    )


def media_fingerprint(path: Column, size: Column, mtime_ms: Column, stream_index: Column) -> Column:
    """SHA-256 over length-prefixed identity parts; changes with file, stream or versions."""
    parts = [path, size, mtime_ms, stream_index, F.lit(SCHEMA_VERSION), F.lit(ALGORITHM_VERSION)]
    pieces = []
    for part in parts:
        text = part.cast("string")
        pieces += [F.octet_length(text).cast("string"), F.lit(":"), text, F.lit("|")]
    return F.sha2(F.concat(*pieces), 256)
