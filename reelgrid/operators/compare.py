"""Quality metrics of frame pairs: MSE, PSNR, SSIM and the SSIM block map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from .metrics import BLOCK_BYTES

PLANE = ("width", "height", "channels", "data")
_SIDES = [f"{s}_{c}" for s in ("a", "b") for c in PLANE]


def pair_planes(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """pairs (pair_id, a_media, a_index, b_media, b_index) with both planes; a side may be missing."""
    out = pairs
    for side in ("a", "b"):
        p = planes.select(
            F.col("media_id").alias(f"{side}_media"),
            F.col("presentation_index").alias(f"{side}_index"),
            *[F.col(c).alias(f"{side}_{c}") for c in PLANE],
        )
        out = out.join(p, [f"{side}_media", f"{side}_index"], "left")
    return out


def comparability(pairs: DataFrame) -> DataFrame:
    """pairs + ``comparable`` and ``detail``: both sides present, sizes equal and valid."""
    missing = F.col("a_data").isNull() | F.col("b_data").isNull()
    differ = (F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height"))
    invalid = (F.col("a_width") <= 0) | (F.col("a_height") <= 0)
    sizes = F.format_string("size_mismatch %dx%d vs %dx%d", "a_width", "a_height", "b_width", "b_height")
    detail = (
        F.when(missing, F.lit("missing_side"))
        .when(differ, sizes)
        .when(invalid, F.lit("invalid_size"))
    )
    return pairs.withColumn("detail", detail).withColumn("comparable", F.col("detail").isNull())


def _blocks(batch: pa.RecordBatch):
    """(row numbers, a, b, width, height, channels) for runs of comparable rows of one shape."""
    shape = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_width", "a_height", "a_channels")]
    a, b = batch.column("a_data"), batch.column("b_data")
    _, which = np.unique(np.stack(shape, axis=1), axis=0, return_inverse=True)
    for k in range(which.max() + 1 if len(which) else 0):
        rows = np.flatnonzero(which.ravel() == k)
        w, h, c = (int(s[rows[0]]) for s in shape)
        step = max(1, BLOCK_BYTES // (w * h * c))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield (
                part,
                pixels.stack([a[int(i)].as_py() for i in part], w * h * c),
                pixels.stack([b[int(i)].as_py() for i in part], w * h * c),
                w, h, c,
            )


def _metrics_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        usable = batch.column("comparable").to_numpy(zero_copy_only=False).astype(bool)
        places = np.flatnonzero(usable)
        mse, ssim = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for rows, a, b, w, h, c in _blocks(batch.filter(pa.array(usable))):
            error = pixels.squared_error(a, b, c)
            score, count = pixels.block_ssim(a, b, w, h, c)
            mse[places[rows]] = error / (w * h * 3.0)
            mean = (score * count).sum(axis=(1, 2)) / count.sum()
            ssim[places[rows]] = np.where(error == 0, 1.0, np.clip(mean, 0.0, 1.0))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("pair_id", "comparable", "detail")],
                pa.array(mse, mask=~usable), pa.array(ssim, mask=~usable),
            ],
            names=["pair_id", "comparable", "detail", "mse", "ssim"],
        )


def compare_pairs(pairs: DataFrame, pair_type: str = "bigint") -> DataFrame:
    """pair_id, comparable, detail, mse, psnr, ssim of pairs with both planes attached.

    One kernel sees all pairs, so the planes are joined and read once.
    """
    checked = comparability(pairs).select("pair_id", "comparable", "detail", *_SIDES)
    scored = checked.mapInArrow(
        _metrics_kernel, f"pair_id {pair_type}, comparable boolean, detail string, mse double, ssim double"
    )
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(
        F.log10(F.lit(255.0 * 255.0) / F.col("mse")) * 10.0
    )
    return scored.select("pair_id", "comparable", "detail", "mse", psnr.alias("psnr"), "ssim")


def _map_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("pair_id")
        for rows, a, b, w, h, c in _blocks(batch):
            score, count = pixels.block_ssim(a, b, w, h, c)
            per = score.shape[1] * score.shape[2]
            grid = np.indices(score.shape[1:]).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(rows, per))),
                    pa.array(np.tile(grid[0], len(rows)).astype(np.int32)),
                    pa.array(np.tile(grid[1], len(rows)).astype(np.int32)),
                    pa.array(np.tile(count.ravel(), len(rows)).astype(np.int32)),
                    pa.array(score.reshape(-1)),
                ],
                names=["pair_id", "block_y", "block_x", "pixels", "ssim"],
            )


def ssim_map(pairs: DataFrame, pair_type: str = "bigint") -> DataFrame:
    """One row per 8x8 block of each comparable pair."""
    usable = comparability(pairs).where("comparable").select("pair_id", *_SIDES)
    return usable.mapInArrow(
        _map_kernel, f"pair_id {pair_type}, block_y int, block_x int, pixels int, ssim double"
    )
