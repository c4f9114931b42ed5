"""Evenly spaced integer positions and sheet grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preset sheets, cells -> (columns, rows).
PRESETS = {8: (4, 2), 16: (4, 4), 20: (5, 4), 25: (5, 5)}


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def spaced_at(start: Column, end: Column, i: Column, intervals: Column) -> Column:
    """Point ``i`` of ``intervals`` equal steps, floored, without overflow of span * i."""
    span = end - start
    return start + div(span, intervals) * i + div((span % intervals) * i, intervals)


def evenly_spaced(start: Column, end: Column, count: Column) -> Column:
    """Array of ``count`` points with both ends; one point when that cannot be."""
    start, end, count = (c.cast("bigint") for c in (start, end, count))
    many = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))),
        lambda i: spaced_at(start, end, i, F.greatest(count - 1, F.lit(1))),
    )
    return (
        F.when(count <= 0, F.array().cast("array<bigint>"))
        .when((count == 1) | (end <= start), F.array(start))
        .otherwise(many)
    )


def grid_columns(cells: Column) -> Column:
    n = F.greatest(cells.cast("int"), F.lit(1))
    out = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    for size, (columns, _) in PRESETS.items():
        out = F.when(cells == size, F.lit(columns)).otherwise(out)
    return out


def grid_rows(cells: Column) -> Column:
    n = F.greatest(cells.cast("int"), F.lit(1))
    columns = grid_columns(cells)
    out = F.greatest(div(n + columns - 1, columns).cast("int"), F.lit(1))
    for size, (_, rows) in PRESETS.items():
        out = F.when(cells == size, F.lit(rows)).otherwise(out)
    return out
