"""Ordered access to the rows of a media, safe when one media holds most of the rows.

A plain ``Window.partitionBy('media_id')`` puts a whole media into one task. ``arrange`` counts
the rows per media first; when every media is small the plain window is used, and when some are
not, rows get a chunk number (quantile ranges of their time, so chunks are even whatever the
time distribution) and every operator below runs its window per (media, chunk) and repairs the
chunk edges from a one-row-per-chunk summary. Both forms give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import FRAME_ORDER
from ..session import materialise

CHUNK = "_chunk"
CHUNK_ROWS_SETTING = "reelgrid.chunk.rows"
CHUNK_ROWS = 2_000_000
MAX_CHUNKS = 4096
# Cut points are broadcast only below this many values (8 bytes each); above it they are joined.
MAX_BROADCAST_CUTS = 1_000_000


@dataclass(frozen=True)
class Ordered:
    """A DataFrame with a grouping key, an order inside the group, and its chunking."""

    df: DataFrame
    keys: tuple[str, ...] = ("media_id",)
    order: tuple[str, ...] = FRAME_ORDER
    split: bool = False

    @property
    def part(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else list(self.keys)

    @property
    def rank(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def window(self, reverse: bool = False) -> WindowSpec:
        columns = [
            F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.order
        ]
        return Window.partitionBy(*self.part).orderBy(*columns)

    def chunks(self, reverse: bool = False) -> WindowSpec:
        """Window over the per-chunk summary rows of one group."""
        order = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
        return Window.partitionBy(*self.keys).orderBy(order)

    def to(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def columns(self, *extra: str) -> list[str]:
        return list(dict.fromkeys([*self.part, *extra]))

    def plain(self) -> DataFrame:
        return self.df.drop(CHUNK)


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_SETTING, str(CHUNK_ROWS)))


def small_groups(df: DataFrame, keys: tuple[str, ...] = ("media_id",), rows_per_chunk: int | None = None) -> bool:
    """Whether no group exceeds the chunk size; one map-side combined count."""
    return large_groups(df, keys, rows_per_chunk or chunk_rows(df))[1] == 0


def large_groups(df: DataFrame, keys: tuple[str, ...], limit: int) -> tuple[DataFrame, int, int]:
    """The groups of more rows than ``limit``, how many there are, and the rows of the biggest."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    groups, biggest = large.agg(F.count(F.lit(1)), F.max("_n")).first()
    return large, groups, biggest or 0


def arrange(
    df: DataFrame | Ordered,
    keys: tuple[str, ...] = ("media_id",),
    order: tuple[str, ...] = FRAME_ORDER,
    rows_per_chunk: int | None = None,
) -> Ordered:
    """Attach an order; split groups that exceed ``rows_per_chunk`` rows into time chunks.

    Costs one pass over the key column (a map-side combined count returning one row). The first
    order column must be numeric; rows with equal first order value stay in one chunk.
    """
    if isinstance(df, Ordered):
        return df
    limit = rows_per_chunk or chunk_rows(df)
    large, groups, biggest = large_groups(df, keys, limit)
    if not groups:
        return Ordered(df, tuple(keys), tuple(order))
    count = min(-(-biggest // limit), MAX_CHUNKS)
    steps = [i / count for i in range(1, count)] or [0.5]
    # The sketch is not deterministic across retries, so the cut points are written once.
    cuts = materialise(
        df.select(*keys, order[0])
        .join(large.select(*keys), list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order[0], steps, max(10_000, 20 * count)).alias("_cuts"))
    )
    side = F.broadcast(cuts) if groups * count <= MAX_BROADCAST_CUTS else cuts
    chunked = df.join(side, list(keys), "left").withColumn(CHUNK, _cuts_passed(F.col(order[0]), len(steps)))
    return Ordered(chunked.drop("_cuts"), tuple(keys), tuple(order), True)


def _cuts_passed(value: Column, size: int) -> Column:
    """Number of sorted cut points <= value, by binary search; 0 where there are none."""
    steps = F.array(*[F.lit(1 << b) for b in range(size.bit_length() - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda acc, step: F.when(
            F.coalesce(F.get(F.col("_cuts"), acc + step - 1) <= value, F.lit(False)), acc + step
        ).otherwise(acc),
    )
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(found)


def sequence(
    o: Ordered,
    payload: list[str] | None = None,
    pos: bool = True,
    prev: bool = False,
    next: bool = False,
    names: tuple[str, str, str] = ("_pos", "_prev", "_next"),
) -> Ordered:
    """Dense 0-based position and the neighbouring rows (as structs of ``payload``)."""
    w = o.window()
    pos_name, prev_name, next_name = names
    body = F.struct(*payload) if payload else None
    added: dict[str, Column] = {}
    if pos:
        added[pos_name] = (F.row_number().over(w) - 1).cast("bigint")
    if prev:
        added[prev_name] = F.lag(body).over(w)
    if next:
        added[next_name] = F.lead(body).over(w)
    df = o.df.withColumns(added)
    if not o.split:
        return o.to(df)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if prev:
        aggs.append(F.max_by(body, o.rank).alias("_tail"))
    if next:
        aggs.append(F.min_by(body, o.rank).alias("_head"))
    c = o.chunks()
    carry = o.df.groupBy(*o.part).agg(*aggs)
    carried: list[Column] = []
    if pos:
        before = F.sum("_n").over(c.rowsBetween(Window.unboundedPreceding, -1))
        carried.append(F.coalesce(before, F.lit(0)).alias("_offset"))
    if prev:
        carried.append(F.lag("_tail").over(c).alias("_carry_prev"))
    if next:
        carried.append(F.lead("_head").over(c).alias("_carry_next"))
    df = df.join(carry.select(*o.part, *carried), o.part)
    fixed: dict[str, Column] = {}
    if pos:
        fixed[pos_name] = F.col(pos_name) + F.col("_offset")
    if prev:
        fixed[prev_name] = F.coalesce(prev_name, "_carry_prev")
    if next:
        fixed[next_name] = F.coalesce(next_name, "_carry_next")
    return o.to(df.withColumns(fixed).drop("_offset", "_carry_prev", "_carry_next"))


def carry_last(
    o: Ordered, value: Column, name: str, inclusive: bool = True, reverse: bool = False
) -> Ordered:
    """Latest non-null ``value`` up to the current row (or before it); reverse looks ahead."""
    w = o.window(reverse).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = o.df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    if not o.split:
        return o.to(df)
    pick = F.min_by if reverse else F.max_by
    edge = o.df.where(value.isNotNull()).groupBy(*o.part).agg(pick(value, o.rank).alias("_edge"))
    # Chunks without any value still have to pass one on.
    every = o.df.select(*o.part).distinct().join(edge, o.part, "left")
    c = o.chunks(reverse).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*o.part, F.last("_edge", ignorenulls=True).over(c).alias("_carry"))
    return o.to(df.join(carry, o.part).withColumn(name, F.coalesce(name, "_carry")).drop("_carry"))


def running_sum(o: Ordered, value: Column, name: str, inclusive: bool = True) -> Ordered:
    """Running total in order."""
    w = o.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = o.df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    if not o.split:
        return o.to(df)
    c = o.chunks().rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        o.df.groupBy(*o.part)
        .agg(F.sum(value).alias("_n"))
        .select(*o.part, F.coalesce(F.sum("_n").over(c), F.lit(0)).alias("_offset"))
    )
    return o.to(df.join(carry, o.part).withColumn(name, F.col(name) + F.col("_offset")).drop("_offset"))


def trailing(o: Ordered, value: Column, size: int, name: str) -> Ordered:
    """Array of the ``size`` rows before the current one, oldest first."""
    w = o.window().rowsBetween(-size, -1)
    df = o.df.withColumn(name, F.collect_list(value).over(w))
    if not o.split:
        return o.to(df)
    back = o.window(reverse=True)
    tails = (
        o.df.withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= size)
        .groupBy(*o.part)
        .agg(F.collect_list(F.struct(F.col("_back"), value.alias("v"))).alias("_tail"))
        .withColumn("_tail", F.transform(F.reverse(F.array_sort("_tail")), lambda x: x["v"]))
    )
    # Each non-empty chunk gives at least one row, so ``size`` chunks always suffice.
    c = o.chunks().rowsBetween(-size, -1)
    carry = tails.select(*o.part, F.flatten(F.collect_list("_tail").over(c)).alias("_carry"))
    joined = F.concat(F.coalesce("_carry", F.array().cast(df.schema[name].dataType)), name)
    length = F.size(joined)
    sliced = F.slice(joined, F.greatest(length - size, F.lit(0)) + 1, F.lit(size))
    return o.to(df.join(carry, o.part, "left").withColumn(name, sliced).drop("_carry"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def settle(o: Ordered) -> Ordered:
    """Write a chunked intermediate once, so chained edge repairs do not recompute it."""
    return o.to(materialise(o.df)) if o.split else o
