"""Level-of-detail aggregates over time, per media."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LodConfig
from ..functions.scores import unit
from ..functions.spacing import div
from ..functions.timebase import clamp_time, nominal_frame_duration
from .order import Ordered, small_groups, union_all

SCORES = {"motion": "motion", "similarity": "similarity", "scene": "scene_score"}
DEFAULT_FRAME_NS = 33_333_333


def estimated_samples(media: DataFrame, maximum: int | None = None) -> DataFrame:
    """media + ``estimated``: declared frames, else duration over the nominal frame duration."""
    nominal = F.coalesce(
        F.nullif(nominal_frame_duration(F.col("avg_rate")), F.lit(0)),
        F.nullif(nominal_frame_duration(F.col("real_rate")), F.lit(0)),
        F.lit(DEFAULT_FRAME_NS).cast("bigint"),
    )
    estimate = (
        F.when(F.col("declared_frames") > 0, F.col("declared_frames"))
        .when(F.col("duration_ns") > 0, div(F.col("duration_ns"), nominal) + 1)
        .otherwise(F.lit(1))
    )
    return media.withColumn("estimated", estimate if maximum is None else F.least(estimate, F.lit(maximum).cast("bigint")))


def lod_geometry(media: DataFrame, config: LodConfig = LodConfig()) -> DataFrame:
    """media_id, duration_ns, span_ns, buckets, levels from duration and ``estimated``.

    ``media`` carries media_id, duration_ns and estimated. Media without a positive duration
    have no pyramid.
    """
    config = config.normalized()
    target = F.greatest(F.least(F.col("estimated"), F.lit(config.base_buckets)), F.lit(1))
    span = F.greatest(div(F.col("duration_ns") + target - 1, target), F.lit(1))
    sized = (
        media.where(F.col("duration_ns") > 0)
        .select("media_id", "duration_ns", span.alias("span_ns"))
        .withColumn("buckets", div(F.col("duration_ns") + F.col("span_ns") - 1, F.col("span_ns")))
    )
    # Level k exists while the level below still has more than one bucket.
    above = F.lit(1)
    for k in range(1, config.levels):
        width = config.grouping ** (k - 1)
        if width > config.base_buckets:
            break
        above = above + F.when(F.col("buckets") > width, 1).otherwise(0)
    return sized.withColumn("levels", above.cast("int"))


def bucket_of(time: Column, duration: Column, span: Column, buckets: Column) -> Column:
    """Bucket index of a time; the end of the media belongs to the last bucket."""
    t = clamp_time(time, duration)
    return F.when(t >= duration, buckets - 1).otherwise(F.least(div(t, span), buckets - 1))


def _accumulate() -> list[Column]:
    out = [F.count(F.lit(1)).alias("sample_count")]
    for name, column in SCORES.items():
        value = unit(F.col(column))
        value = F.when(F.col(column).isNotNull(), value)
        out += [
            F.count(column).alias(f"{name}_count"),
            F.sum(value.cast("double")).alias(f"{name}_sum"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return out


def _merge() -> list[Column]:
    out = [F.sum("sample_count").alias("sample_count")]
    for name in SCORES:
        out += [
            F.sum(f"{name}_count").alias(f"{name}_count"),
            F.sum(f"{name}_sum").alias(f"{name}_sum"),
            F.min(f"{name}_min").alias(f"{name}_min"),
            F.max(f"{name}_max").alias(f"{name}_max"),
        ]
    return out


def _state() -> list[str]:
    return ["sample_count", *[f"{s}_{a}" for s in SCORES for a in ("count", "sum", "min", "max")]]


# Levels above the base that one block of base buckets holds; higher ones start from its single top bucket.
BLOCK_LEVELS = 6
# Rows that a task folds at once.
FOLD_ROWS = 65_536


def _keyed(samples: DataFrame | Ordered, geometry: DataFrame) -> DataFrame:
    rows = samples.df if isinstance(samples, Ordered) else samples
    return (
        rows.where(F.col("pt_ns").isNotNull())
        .select("media_id", "pt_ns", *SCORES.values())
        .join(geometry, "media_id")
        .withColumn(
            "bucket",
            bucket_of(F.col("pt_ns"), F.col("duration_ns"), F.col("span_ns"), F.col("buckets")),
        )
        .select("media_id", "bucket", "levels", *SCORES.values())
    )


def lod_base(samples: DataFrame | Ordered, geometry: DataFrame) -> DataFrame:
    """Base accumulators: one map-side combined aggregate on (media, bucket).

    ``levels`` is a property of the media that rides along in the key.
    """
    return _keyed(samples, geometry).groupBy("media_id", "bucket", "levels").agg(*_accumulate())


def lod_levels(base: DataFrame, config: LodConfig = LodConfig()) -> DataFrame:
    """All levels from base accumulators: media_id, level, bucket and accumulator columns."""
    return _levels(base, config)


def _levels(rows: DataFrame, config: LodConfig) -> DataFrame:
    """All levels of rows keyed by media and base bucket, raw or accumulated.

    The levels above a block's start from sums over runs of neighbouring rows of the same exchange: rows that
    come in order, as samples do, leave few to merge.

    Rows are placed once, by blocks of base buckets and in their order. There every level is folded from
    the one below in one pass; the top bucket of each block is all that the levels above are made of.
    """
    config = config.normalized()
    most, width = _most_levels(config), config.grouping**BLOCK_LEVELS
    placed = rows.withColumn("block", div(F.col("bucket"), width)).repartition("media_id", "block")
    low = _cascade(placed, config, min(BLOCK_LEVELS + 1, most))
    if most <= BLOCK_LEVELS + 1:
        return low
    first = BLOCK_LEVELS + 1
    # From the same exchange as the low levels; only rows of tall media count.
    tops = _run_tops(placed, width * config.grouping, first)
    high = _exploded(tops, config, first, most).groupBy("media_id", "level", "bucket").agg(*_merge())
    return low.unionByName(high)


def _fold(keys: list[np.ndarray], state: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sums, minima and maxima over runs of equal keys, and where the runs start. Absent minima and maxima are NaN."""
    n = len(keys[0])
    opens = np.ones(n, bool)
    opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(opens)
    if len(at) == n:
        return at, state
    ways = {"min": np.fmin, "max": np.fmax}
    return at, {c: ways.get(c[-3:], np.add).reduceat(v, at) for c, v in state.items()}


_SUMS = {c for c in _state() if c[-3:] not in ("min", "max")}
_FORM = [(c, pa.int64() if c.endswith("count") else pa.float64() if c in _SUMS else pa.float32()) for c in _state()]
_SCHEMA = ", ".join(f"{c} {'bigint' if c.endswith('count') else 'double' if c in _SUMS else 'float'}" for c in _state())


def _slim(rows: DataFrame, *more: str) -> DataFrame:
    """Keys and, of raw rows, the three scores within their bounds; of accumulators, these."""
    scores = [F.when(F.col(c).isNotNull(), unit(F.col(c))).alias(n) for n, c in SCORES.items()]
    return rows.select("media_id", *more, "bucket", "levels", *(_state() if "sample_count" in rows.columns else scores))


def _accumulators(part: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    numbers = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    if "sample_count" in part.schema.names:
        return {c: numbers(c).astype(np.int64) if c.endswith("count") else np.nan_to_num(numbers(c)) if c in _SUMS else numbers(c) for c in _state()}
    out = {"sample_count": np.ones(part.num_rows, np.int64)}
    for name in SCORES:
        v = numbers(name)
        there = ~np.isnan(v)
        out |= {f"{name}_count": there.astype(np.int64), f"{name}_sum": np.where(there, v, 0.0), f"{name}_min": v, f"{name}_max": v}
    return out


def _columns(body: dict[str, np.ndarray]) -> list[pa.Array]:
    # A sum without values is null, as a minimum is.
    none = lambda c: np.isnan(body[c]) if c not in _SUMS else body[c[:-3] + "count"] == 0 if c.endswith("sum") else None
    return [pa.array(body[c], mask=none(c)).cast(kind) for c, kind in _FORM]


def _run_tops(placed: DataFrame, width: int, above: int) -> DataFrame:
    """Of media with more than ``above`` levels, accumulators of buckets ``width`` times the base, over runs of neighbouring rows: several a bucket where rows are not in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(batch.column("levels"), above))
            if not batch.num_rows:
                continue
            names = batch.column("media_id")
            bucket, levels = (batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "levels"))
            bucket = bucket // width
            at, body = _fold([names.dictionary_encode().indices.to_numpy(), bucket], _accumulators(batch))
            columns = [names.take(pa.array(at)), pa.array(bucket[at]), pa.array(levels[at].astype(np.int32)), *_columns(body)]
            yield pa.RecordBatch.from_arrays(columns, names=["media_id", "bucket", "levels", *[n for n, _ in _FORM]])

    return _slim(placed, "block").mapInArrow(run, "media_id string, bucket bigint, levels int, " + _SCHEMA)


def _cascade(placed: DataFrame, config: LodConfig, stop: int) -> DataFrame:
    """Levels below ``stop`` of rows that lie in the partition of their block; raw rows or accumulators."""
    slim, state = _slim(placed, "block"), _state()
    form = [("media_id", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), *_FORM]
    schema = "media_id string, level int, bucket bigint, " + _SCHEMA

    def table(media: pa.Array, level: int, bucket: np.ndarray, body: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = [media, pa.array(np.full(len(bucket), level, np.int32)), pa.array(bucket)]
        return pa.RecordBatch.from_arrays([*columns, *_columns(body)], names=[n for n, _ in form])

    def folded(part: pa.Table, held: tuple | None, last: bool) -> tuple[list[pa.RecordBatch], tuple | None]:
        names = part.column("media_id").combine_chunks()
        whole = [part.column(c).to_numpy().astype(np.int64) for c in ("block", "bucket", "levels")]
        body = _accumulators(part)
        if held is not None:
            names = pa.concat_arrays([held[0], names])
            whole = [np.concatenate([a, b]) for a, b in zip(held[1], whole)]
            body = {c: np.concatenate([held[2][c], v]) for c, v in body.items()}
        codes = names.dictionary_encode().indices.to_numpy()
        at, body = _fold([codes, whole[1]], body)
        codes, names, (block, bucket, levels) = codes[at], names.take(pa.array(at)), [v[at] for v in whole]
        # The last block may go on in the next rows.
        opens = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
        cut = len(codes) if last else int(opens[-1]) if len(opens) else 0
        rest = None if last else (names[cut:], [block[cut:], bucket[cut:], levels[cut:]], {c: v[cut:] for c, v in body.items()})
        out = []
        codes, names, bucket, levels, body = codes[:cut], names[:cut], bucket[:cut], levels[:cut], {c: v[:cut] for c, v in body.items()}
        for level in range(stop):
            if not len(codes):
                break
            out.append(table(names, level, bucket, body))
            more = np.flatnonzero(levels > level + 1)
            codes, bucket, levels, body = codes[more], bucket[more] // config.grouping, levels[more], {c: v[more] for c, v in body.items()}
            names = names.take(pa.array(more))
            if len(codes):
                at, body = _fold([codes, bucket], body)
                codes, bucket, levels, names = codes[at], bucket[at], levels[at], names.take(pa.array(at))
        return out, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, held = [], 0, None
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= FOLD_ROWS:
                out, held = folded(pa.Table.from_batches(waiting), held, False)
                yield from out
                waiting, rows = [], 0
        if rows or held is not None:
            part = pa.Table.from_batches(waiting) if waiting else None
            if part is None:
                part = empty
            out, _ = folded(part, held, True)
            yield from out

    kinds = {"media_id": pa.string(), **{c: pa.int64() for c in ("block", "bucket", "levels")}}
    empty = pa.table({f.name: pa.array([], kinds.get(f.name, pa.float64())) for f in slim.schema})
    return slim.sortWithinPartitions("media_id", "bucket").mapInArrow(run, schema)


def _exploded(rows: DataFrame, config: LodConfig, first: int, stop: int) -> DataFrame:
    """Rows, being buckets of level ``first``, once per level below ``stop`` that their media has."""
    level = F.explode(F.sequence(F.lit(first), F.least(F.col("levels"), F.lit(stop)) - 1))
    bucket = F.col("bucket")
    for k in range(1, stop - first):
        bucket = F.when(F.col("level") == first + k, div(F.col("bucket"), config.grouping**k)).otherwise(bucket)
    return rows.withColumn("level", level).withColumn("bucket", bucket)


def _most_levels(config: LodConfig) -> int:
    """Levels a media can have at most under the base bucket limit."""
    n, width = 1, 1
    while n < config.levels and width < config.base_buckets:
        n, width = n + 1, width * config.grouping
    return n


def lod_finish(levels: DataFrame, geometry: DataFrame, config: LodConfig = LodConfig()) -> DataFrame:
    """Add bucket bounds and averages: the ``lod`` table."""
    config = config.normalized()
    g = geometry.select("media_id", "duration_ns", "span_ns")
    widths = F.array(*[F.lit(min(config.grouping**k, 2**63 - 1)).cast("bigint") for k in range(config.levels)])
    width = F.try_multiply(F.col("span_ns"), F.get(widths, F.col("level")))

    def bound(index: Column) -> Column:
        # A bound beyond BIGINT lies beyond the media as well.
        return F.coalesce(F.least(F.try_multiply(index, width), F.col("duration_ns")), F.col("duration_ns"))

    out = levels.join(g, "media_id").withColumns(
        {"start_ns": bound(F.col("bucket")), "end_ns": bound(F.col("bucket") + 1)}
    )
    averages = {
        f"{s}_avg": (F.col(f"{s}_sum") / F.nullif(F.col(f"{s}_count"), F.lit(0))).cast("float") for s in SCORES
    }
    return out.withColumns(averages).drop("duration_ns", "span_ns")


def build_lod(
    samples: DataFrame | Ordered, geometry: DataFrame, config: LodConfig = LodConfig()
) -> DataFrame:
    """The ``lod`` table of a samples table.

    Where no media is large (one count, made by ``arrange`` or here) a block holds few rows and slim samples
    go to their block directly; otherwise they are combined into base buckets before the shuffle.
    """
    if not samples.split if isinstance(samples, Ordered) else small_groups(samples):
        levels = _levels(_keyed(samples, geometry), config)
    else:
        levels = lod_levels(lod_base(samples, geometry), config)
    return lod_finish(levels, geometry, config)


def level_choice(requests: DataFrame, geometry: DataFrame, config: LodConfig = LodConfig()) -> DataFrame:
    """Finest level whose bucket range fits the budget, else the coarsest; with its bucket range.

    requests: media_id, request_id, start_ns, end_ns, budget.
    """
    config = config.normalized()
    d = F.col("duration_ns")
    start, end = clamp_time(F.col("start_ns"), d), clamp_time(F.col("end_ns"), d)
    r = requests.join(geometry, "media_id").withColumns(
        {"range_start_ns": F.least(start, end), "range_end_ns": F.greatest(start, end)}
    )

    def at(column: str, level: Column) -> Column:
        base = bucket_of(F.col(column), d, F.col("span_ns"), F.col("buckets"))
        return div(base, F.pow(F.lit(float(config.grouping)), level).cast("bigint"))

    fits = F.filter(
        F.sequence(F.lit(0), F.col("levels") - 1),
        lambda k: at("range_end_ns", k) - at("range_start_ns", k) + 1 <= F.greatest(F.col("budget"), F.lit(1)),
    )
    level = F.coalesce(F.get(fits, F.lit(0)), F.col("levels") - 1)
    return r.withColumn("level", level).select(
        "media_id",
        "request_id",
        "level",
        "range_start_ns",
        "range_end_ns",
        F.pow(F.lit(float(config.grouping)), F.col("level")).cast("bigint").alias("source_buckets"),
        at("range_start_ns", F.col("level")).alias("first_bucket"),
        at("range_end_ns", F.col("level")).alias("last_bucket"),
    )


def lod_view(
    lod: DataFrame, requests: DataFrame, geometry: DataFrame, config: LodConfig = LodConfig()
) -> DataFrame:
    """Non-empty buckets of each request at its chosen level.

    A request wants no more buckets than its budget, or those of the coarsest level, so it is joined
    by (media, level, bucket) instead of meeting every bucket of its media.
    """
    chosen = level_choice(requests, geometry, config)
    wanted = chosen.withColumn("bucket", F.explode(F.sequence("first_bucket", "last_bucket")))
    wanted = wanted.drop("first_bucket", "last_bucket")
    body = [c for c in lod.columns if c not in wanted.columns]
    return wanted.join(lod, ["media_id", "level", "bucket"]).select(
        *[c for c in wanted.columns if c != "bucket"], "bucket", *body
    )


def aligned_range(start: Column, end: Column, geometry: dict[str, Column]) -> tuple[Column, Column]:
    """Bucket-aligned time range that covers [start, end]."""
    d, span, buckets = geometry["duration_ns"], geometry["span_ns"], geometry["buckets"]
    first = bucket_of(F.least(start, end), d, span, buckets)
    last = bucket_of(F.greatest(start, end), d, span, buckets)
    return F.least(first * span, d), F.least((last + 1) * span, d)


def replace_range(
    levels: DataFrame,
    changed: DataFrame,
    samples: DataFrame,
    geometry: DataFrame,
    config: LodConfig = LodConfig(),
) -> DataFrame:
    """Accumulators after the samples of some time ranges were replaced.

    changed: media_id, start_ns, end_ns. Touched base buckets are rebuilt from ``samples`` (the
    rows now stored for them) and only their ancestors are aggregated again.
    """
    config = config.normalized()
    d, span, buckets = F.col("duration_ns"), F.col("span_ns"), F.col("buckets")
    low, high = F.least("start_ns", "end_ns"), F.greatest("start_ns", "end_ns")
    touched = (
        changed.join(geometry, "media_id")
        .select(
            "media_id",
            F.explode(F.sequence(bucket_of(low, d, span, buckets), bucket_of(high, d, span, buckets))).alias("bucket"),
        )
        .distinct()
    )
    base = (
        _keyed(samples, geometry)
        .join(touched, ["media_id", "bucket"], "left_semi")
        .groupBy("media_id", "bucket")
        .agg(*_accumulate())
    )
    stored = levels.select("media_id", "level", "bucket", *_state())
    # Parents are merged from their children one level at a time, so only siblings of touched
    # buckets are read; ``ancestors`` derives from the small touched set at every level.
    parts = [
        stored.join(_ancestors(touched, config), ["media_id", "level", "bucket"], "left_anti"),
        base.withColumn("level", F.lit(0)),
    ]
    current = base
    for level in range(1, config.levels):
        if config.grouping ** (level - 1) >= config.base_buckets:
            break
        changed_here = _at_level(touched, config.grouping**level)
        changed_below = _at_level(touched, config.grouping ** (level - 1))
        siblings = (
            stored.where(F.col("level") == level - 1)
            .drop("level")
            .join(changed_below, ["media_id", "bucket"], "left_anti")
            .withColumn("parent", div(F.col("bucket"), config.grouping))
            .join(changed_here.withColumnRenamed("bucket", "parent"), ["media_id", "parent"], "left_semi")
        )
        current = (
            current.withColumn("parent", div(F.col("bucket"), config.grouping))
            .unionByName(siblings)
            .groupBy("media_id", "parent")
            .agg(*_merge())
            .withColumnRenamed("parent", "bucket")
        )
        exists = geometry.where(F.col("levels") > level).select("media_id")
        current = current.join(exists, "media_id", "left_semi")
        parts.append(current.withColumn("level", F.lit(level)))
    return union_all(parts)


def _at_level(touched: DataFrame, width: int) -> DataFrame:
    return touched.select("media_id", div(F.col("bucket"), width).alias("bucket")).distinct()


def _ancestors(touched: DataFrame, config: LodConfig) -> DataFrame:
    levels = [
        F.struct(F.lit(k).alias("level"), div(F.col("bucket"), config.grouping**k).alias("bucket"))
        for k in range(config.levels)
        if k == 0 or config.grouping ** (k - 1) < config.base_buckets
    ]
    return (
        touched.select("media_id", F.explode(F.array(*levels)).alias("_a"))
        .select("media_id", "_a.level", "_a.bucket")
        .distinct()
    )


def coverage(samples: DataFrame, media: DataFrame) -> DataFrame:
    """Analysed share per media: samples over declared frames, else latest end over duration."""
    latest = F.struct("pt_ns", "presentation_index", "pts")
    rows = samples.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max_by(F.col("pt_ns") + F.col("duration_ns"), latest).alias("covered_ns"),
    )
    by_count = F.col("sample_count") / F.col("declared_frames")
    by_time = F.col("covered_ns") / F.col("duration_ns")
    ratio = F.when(F.col("declared_frames") > 0, by_count).when(F.col("duration_ns") > 0, by_time).otherwise(0.0)
    clamped = F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0))
    return (
        media.select("media_id", "declared_frames", "duration_ns")
        .join(rows, "media_id", "left")
        .select(
            "media_id",
            F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
            F.when(F.col("sample_count") > 0, clamped).otherwise(0.0).alias("coverage"),
        )
    )
