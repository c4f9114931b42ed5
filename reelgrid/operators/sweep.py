"""One ordered pass over the rows of a media and the two ends of every range.

Where every media fits one task, ``searched`` orders the rows of each once and looks both ends up in them.
Where one does not, rows and ends are swept together, chunk by chunk: starts stand before rows of the same time and ends after them, so what has been counted at an end's
place is what the range's position, gap and key counts follow from. All windows of a pass share one
partitioning and one order; only the view of what comes next sorts the same partitions once more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import FRAME_ORDER
from .order import Ordered, arrange, carry_last, running_sum, settle, small_groups

START, ROW, END = 0, 1, 2
KIND, TIME = "_kind", "_t"
SPAN = ("start_ns", "end_ns")


def events(spans: DataFrame, rows: DataFrame | Ordered, body: list[str]) -> Ordered:
    """Rows (with ``body``) and the ends of distinct spans (media_id, start_ns, end_ns) in one order per media."""
    source = rows.plain() if isinstance(rows, Ordered) else rows
    ranks = [c for c in FRAME_ORDER[1:] if c in source.columns]
    slim = source.select(
        "media_id", F.col("pt_ns").alias(TIME), F.lit(ROW).alias(KIND), *[F.col(c).alias(f"_{c}") for c in ranks], F.struct(*body).alias("_row"),
        *[F.lit(None).cast("bigint").alias(c) for c in SPAN],
    )
    absent = {f.name: F.lit(None).cast(f.dataType) for f in slim.schema if f.name not in ("media_id", TIME, KIND, *SPAN)}
    ends = spans.withColumn("_e", F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(k).alias("k")) for c, k in zip(SPAN, (START, END))])))
    ends = ends.withColumns({TIME: F.col("_e.t"), KIND: F.col("_e.k"), **absent})
    return arrange(slim.unionByName(ends.select(*slim.columns)), order=(TIME, KIND, *[f"_{c}" for c in ranks]))


def is_row() -> Column:
    return F.col(KIND) == ROW


def counted(o: Ordered, value: Column, name: str) -> Ordered:
    """Running total of a value over rows, up to each place."""
    return settle(running_sum(o, F.when(is_row(), value).otherwise(0).cast("bigint"), name))


def before(o: Ordered, value: Column, name: str) -> Ordered:
    """The value of the last row before each place."""
    return settle(carry_last(o, F.when(is_row(), value), name, inclusive=False))


def after(o: Ordered, value: Column, name: str) -> Ordered:
    """The value of the next row after each place."""
    return settle(carry_last(o, F.when(is_row(), value), name, inclusive=False, reverse=True))


def paired(o: Ordered, start: list[str], end: list[str]) -> DataFrame:
    """One row per span: the named columns at its start (struct ``s``) and at its end (struct ``e``)."""
    at = lambda kind, names, alias: F.max(F.when(F.col(KIND) == kind, F.struct(*names))).alias(alias)
    return o.df.where(~is_row()).groupBy("media_id", *SPAN).agg(at(START, start, "s"), at(END, end, "e"))


def positions(ranges: DataFrame, rows: DataFrame | Ordered, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """ranges + ``p0``, ``p1``: positions of the first and last row inside; p1 < p0 where there is none."""
    if even(ranges, rows):
        return searched(ranges, rows, [], lambda rows: {}, start, end).drop("total")
    spans = ranges.select("media_id", F.col(start).alias("start_ns"), F.col(end).alias("end_ns")).distinct()
    found = positions_at_ends(spans, rows).withColumnsRenamed({"start_ns": start, "end_ns": end})
    return ranges.join(found, ["media_id", start, end])


def positions_at_ends(spans: DataFrame, rows: DataFrame | Ordered) -> DataFrame:
    o = counted(events(spans, rows, ["pt_ns"]), F.lit(1), "_n")
    return paired(o, ["_n"], ["_n"]).select("media_id", *SPAN, F.col("s._n").alias("p0"), (F.col("e._n") - 1).alias("p1"))


def even(ranges: DataFrame, rows: DataFrame | Ordered) -> bool:
    """Whether no media has more rows or more ranges than a chunk, so that each fits one task."""
    if isinstance(rows, Ordered):
        return not rows.split and small_groups(ranges.select("media_id"))
    return small_groups(rows.select("media_id")) and small_groups(ranges.select("media_id"))


def searched(
    ranges: DataFrame, rows: DataFrame | Ordered, values: list[str], derive: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], start: str = "start_ns", end: str = "end_ns"
) -> DataFrame:
    """ranges + ``p0``, ``p1`` (first and last position inside), ``total`` (rows of the media), and what ``derive`` makes of rows, at both positions.

    The sweep of ``even`` media without sorting ranges: the rows of a media are put in order once, and
    both ends of all its ranges are looked up in them. ``values``: BIGINT columns of the rows, absent ones -1;
    ``derive`` names arrays over the ordered rows, which come back as ``first_<name>`` and ``last_<name>``.
    """
    source = rows.plain() if isinstance(rows, Ordered) else rows
    ranks = [c for c in FRAME_ORDER[1:] if c in source.columns]
    whole = lambda c, absent: F.coalesce(F.col(c).cast("bigint"), F.lit(absent))
    slim = source.where(F.col("pt_ns").isNotNull()).select(
        "media_id", F.col("pt_ns").alias(TIME), *[whole(c, -(2**63)).alias(f"_{c}") for c in ranks], *[whole(c, -1).alias(f"v_{c}") for c in values]
    )
    names = list(derive({c: np.zeros(0, np.int64) for c in ("pt_ns", *values)}))
    added = ["p0", "p1", "total", *[f"{side}_{n}" for side in ("first", "last") for n in names]]

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda table, c: table.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.lexsort([column(left, c) for c in (*[f"_{c}" for c in reversed(ranks)], TIME)]) if left.num_rows else np.zeros(0, int)
        ordered = {"pt_ns": column(left, TIME)[at], **{c: column(left, f"v_{c}")[at] for c in values}}
        ends = [right.column(c).fill_null(0) for c in (start, end)]
        p0 = np.searchsorted(ordered["pt_ns"], ends[0].to_numpy(), "left").astype(np.int64)
        p1 = np.searchsorted(ordered["pt_ns"], ends[1].to_numpy(), "right").astype(np.int64) - 1
        out = {"p0": pa.array(p0), "p1": pa.array(p1), "total": pa.array(np.full(len(p0), len(at), np.int64))}
        derived = derive(ordered)
        for side, p in (("first", p0), ("last", p1)):
            there = (p >= 0) & (p < len(at))
            for n in names:
                held = derived[n][np.where(there, p, 0)] if len(at) else np.zeros(len(p), np.int64)
                out[f"{side}_{n}"] = pa.array(held.astype(np.int64), mask=~there)
        return pa.Table.from_arrays([*right.columns, *out.values()], names=[*right.column_names, *out])

    schema = StructType(ranges.schema.fields + [StructField(n, LongType()) for n in added])
    return slim.groupBy("media_id").cogroup(ranges.groupBy("media_id")).applyInArrow(look, schema)
