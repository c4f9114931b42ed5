"""The pixel kernels and the small row generators under names for SQL: ``register(spark)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from . import pixels

SCORES = ["motion", "similarity", "scene_score", "duplicate_score"]


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t()) for n, t in fields.items()])



def _by_size(planes: list[pa.Array], sides: list[pa.Array], kernel: Callable, out: np.ndarray) -> pa.Array:
    """Apply a kernel to the rows of each size at once; null where a plane is absent or not as long as its size says."""
    width, height, channels = (np.array([0 if v is None else v for v in s.to_pylist()], np.int64) for s in sides)
    data = [p.to_pylist() for p in planes]
    size = width * height * channels
    fine = np.array([n > 0 and all(d[i] is not None and len(d[i]) == n for d in data) for i, n in enumerate(size)], bool)
    shape = np.stack([width, height, channels], axis=1)
    for w, h, c in {tuple(s) for s in shape[fine].tolist()}:
        at = np.flatnonzero(fine & (shape == (w, h, c)).all(axis=1))
        out[at] = kernel(*[pixels.stack([d[i] for i in at], w * h * c) for d in data], w, h, c)
    return pa.array(out, mask=~fine) if out.ndim == 1 else pa.StructArray.from_arrays(
        [pa.array(c.astype(np.float32)) for c in out.T], names=SCORES, mask=pa.array(~fine)
    )


def _one(like: pa.Array, value: int = 1) -> pa.Array:
    return pa.array(np.full(len(like), value, np.int32))


@arrow_udf(LongType())
def perceptual_hash(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return _by_size([data], [width, height, _one(width)], lambda a, w, h, c: pixels.perceptual_hash(a, w, h).view(np.int64), np.zeros(len(data), np.int64))


@arrow_udf(LongType())
def content_hash(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return _by_size([data], [width, height, _one(width)], lambda a, w, h, c: pixels.content_hash(a, w, h).view(np.int64), np.zeros(len(data), np.int64))


def _scores(a: np.ndarray, b: np.ndarray, width: int, height: int, channels: int) -> np.ndarray:
    overlap = np.minimum(pixels.histogram(a), pixels.histogram(b)).sum(axis=1)
    apart = pixels.popcount(pixels.perceptual_hash(a, width, height).view(np.int64) ^ pixels.perceptual_hash(b, width, height).view(np.int64))
    return np.stack(pixels.pair_scores(pixels.abs_difference_sum(a, b), overlap, apart, a.shape[1]), axis=1)


@arrow_udf(_struct(**dict.fromkeys(SCORES, FloatType)))
def frame_scores(data: pa.Array, previous: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Scores of a gray plane against the one before; null where there is none of that size."""
    return _by_size([data, previous], [width, height, _one(width)], _scores, np.zeros((len(data), 4)))


@arrow_udf(DoubleType())
def plane_mse(a: pa.Array, b: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array) -> pa.Array:
    mean = lambda x, y, w, h, c: pixels.squared_error(x, y, c) / (w * h * 3)
    return _by_size([a, b], [width, height, channels], mean, np.zeros(len(a)))


@arrow_udf(DoubleType())
def plane_ssim(a: pa.Array, b: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array) -> pa.Array:
    def mean(x, y, w, h, c):
        score, counts = pixels.block_ssim(x, y, w, h, c)
        whole = np.clip((score * counts).sum(axis=(1, 2)) / counts.sum(), 0, 1)
        return np.where((x == y).all(axis=1), 1.0, whole)

    return _by_size([a, b], [width, height, channels], mean, np.zeros(len(a)))


@udtf(returnType=_struct(position=LongType, value=LongType))
class EvenlySpaced:
    """Points from ``first`` to ``last``, both included; one point where that cannot be."""

    def eval(self, first: int, last: int, count: int) -> Iterator[tuple[int, int]]:
        if None in (first, last, count) or count <= 0:
            return
        if count == 1 or last <= first:
            yield 0, first
            return
        span, steps = last - first, count - 1
        for i in range(count):
            yield i, first + span // steps * i + span % steps * i // steps


@udtf(returnType=_struct(level=IntegerType, bucket_ns=LongType, buckets=LongType))
class LodLevels:
    """The levels of a media: bucket width and number, until one bucket is left."""

    def eval(self, duration_ns: int, span_ns: int, grouping: int) -> Iterator[tuple[int, int, int]]:
        if None in (duration_ns, span_ns, grouping) or duration_ns <= 0 or span_ns <= 0:
            return
        buckets, width, level = -(-duration_ns // span_ns), span_ns, 0
        while True:
            yield level, min(width, duration_ns), buckets
            if buckets == 1:
                return
            buckets, width, level = -(-buckets // max(2, grouping)), width * max(2, grouping), level + 1


FUNCTIONS = {"perceptual_hash": perceptual_hash, "content_hash": content_hash, "frame_scores": frame_scores, "plane_mse": plane_mse, "plane_ssim": plane_ssim}
TABLE_FUNCTIONS = {"evenly_spaced": EvenlySpaced, "lod_levels": LodLevels}


def register(spark: SparkSession) -> None:
    """Make all of them known to ``spark.sql`` in this session."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
