"""Fingerprints and adjacent-frame scores from image planes.

Planes are shuffled once. Each partition is sorted by media and index and streamed through one
Arrow kernel that computes both hashes of a plane and compares it with the plane before it, so no
plane is sent to Python twice and hashes are reused. The result is slim; times are joined to it,
not to the planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..session import materialise
from .order import CHUNK, Ordered, arrange, chunk_rows, sequence
from .ranges import rows_in_ranges

RESULT = (
    "media_id string, presentation_index bigint, width int, height int, content_hash bigint, "
    "perceptual_hash bigint, motion float, similarity float, scene_score float, "
    "duplicate_score float, status string"
)
_FIELDS = pa.schema(
    [
        ("media_id", pa.string()), ("presentation_index", pa.int64()), ("width", pa.int32()),
        ("height", pa.int32()), ("content_hash", pa.int64()), ("perceptual_hash", pa.int64()),
        ("motion", pa.float32()), ("similarity", pa.float32()), ("scene_score", pa.float32()),
        ("duplicate_score", pa.float32()), ("status", pa.string()),
    ]
)
SCORES = ("motion", "similarity", "scene_score", "duplicate_score")
BLOCK_BYTES = 32 << 20
MAX_SIDE = 2048
# A plane is thousands of times larger than a sample row, so chunks are smaller.
PLANES_PER_CHUNK = 20_000


def valid_planes(planes: DataFrame) -> DataFrame:
    """Planes with positive sides whose data has exactly width * height * channels bytes."""
    size = F.col("width").cast("bigint") * F.col("height") * F.coalesce("channels", F.lit(1))
    return planes.where((F.col("width") > 0) & (F.col("height") > 0) & (F.length("data") == size))


def luma_planes(planes: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Single-channel planes, area-scaled to width x height when given (2048 at most)."""
    if (width is None) != (height is None) or (width and not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE)):
        raise ValueError(f"width and height are given together, each from 1 to {MAX_SIDE}")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = batch.column("width").to_numpy(), batch.column("height").to_numpy()
            c, data = batch.column("channels").to_numpy(), batch.column("data")
            out: list = [None] * batch.num_rows
            for group in _by_shape(w, h, c):
                gw, gh, gc = int(w[group[0]]), int(h[group[0]]), int(c[group[0]])
                block = pixels.stack([data[int(i)].as_py() for i in group], gw * gh * gc)
                if gc > 1:
                    block = np.floor(pixels.gray(block, gc) + 0.5).astype(np.uint8)
                if width is not None and (gw, gh) != (width, height):
                    block = pixels.area_scale(block, gw, gh, width, height)
                for i, row in zip(group, block):
                    out[int(i)] = row.tobytes()
            sides = (w, h) if width is None else (np.full_like(w, width), np.full_like(h, height))
            yield pa.RecordBatch.from_arrays(
                [batch.column("media_id"), batch.column("presentation_index"), pa.array(sides[0]),
                 pa.array(sides[1]), pa.array(np.ones_like(w)), pa.array(out, pa.binary())],
                names=["media_id", "presentation_index", "width", "height", "channels", "data"],
            )

    slim = valid_planes(planes).select(
        "media_id", "presentation_index", "width", "height", F.coalesce("channels", F.lit(1)).alias("channels"), "data"
    )
    return slim.mapInArrow(
        kernel,
        "media_id string, presentation_index bigint, width int, height int, channels int, data binary",
    )


def _by_shape(*sides: np.ndarray) -> list[np.ndarray]:
    shapes = np.stack(sides, axis=1)
    _, which = np.unique(shapes, axis=0, return_inverse=True)
    which = which.ravel()
    return [np.flatnonzero(which == k) for k in range(which.max() + 1)] if len(which) else []


class _Run:
    """The plane before the current batch, with its hash and histogram."""

    __slots__ = ("key", "shape", "plane", "hist", "phash")

    def __init__(self):
        self.key = None


def _analyse(batch: pa.RecordBatch, last: _Run) -> pa.RecordBatch:
    n = batch.num_rows
    media = batch.column("media_id").to_numpy(zero_copy_only=False)
    chunk = batch.column(CHUNK).to_numpy()
    width, height = batch.column("width").to_numpy(), batch.column("height").to_numpy()
    data = batch.column("data")
    content, phash = np.zeros(n, np.int64), np.zeros(n, np.int64)
    scores = np.zeros((4, n), np.float32)
    status = np.full(n, "first", dtype=object)
    at = 0
    while at < n:
        # A stretch of rows of one geometry inside the memory budget.
        size = int(width[at]) * int(height[at])
        stop = at + 1
        most = max(1, BLOCK_BYTES // size)
        while stop < n and stop - at < most and width[stop] == width[at] and height[stop] == height[at]:
            stop += 1
        block = pixels.stack([data[i].as_py() for i in range(at, stop)], size)
        w, h = int(width[at]), int(height[at])
        content[at:stop] = pixels.content_hash(block, w, h)
        phash[at:stop] = pixels.perceptual_hash(block, w, h)
        hist = pixels.histogram(block)
        keys = list(zip(media[at:stop], chunk[at:stop]))
        same = np.array([a == b for a, b in zip([last.key, *keys[:-1]], keys)])
        first = bool(same[0])
        if first and last.shape != (w, h):
            status[at] = "geometry_mismatch"
            first = False
        elif first:
            before, before_hist, before_hash = last.plane, last.hist, last.phash
        if not first:
            before, before_hist, before_hash = block[0], hist[0], phash[at]
        prev = np.concatenate([before[None], block[:-1]])
        prev_hist = np.concatenate([before_hist[None], hist[:-1]])
        prev_hash = np.concatenate([[before_hash], phash[at : stop - 1]]).astype(np.int64)
        moved = pixels.abs_difference_sum(block, prev)
        overlap = np.minimum(hist, prev_hist).sum(axis=1)
        gap = pixels.popcount(phash[at:stop] ^ prev_hash)
        scores[:, at:stop] = pixels.pair_scores(moved, overlap, gap, size)
        ok = same.copy()
        ok[0] = first
        status[at:stop][ok] = "scored"
        last.key, last.shape = keys[-1], (w, h)
        last.plane, last.hist, last.phash = block[-1], hist[-1], phash[stop - 1]
        at = stop
    scored = status == "scored"
    columns = [
        batch.column("media_id"), batch.column("presentation_index"), batch.column("width"),
        batch.column("height"), pa.array(content), pa.array(phash),
        *[pa.array(s, mask=~scored) for s in scores], pa.array(status, pa.string()),
    ]
    out = pa.RecordBatch.from_arrays(columns, schema=_FIELDS)
    return out.filter(pa.array(~batch.column("_halo").to_numpy(zero_copy_only=False)))


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = _Run()
    for batch in batches:
        if batch.num_rows:
            yield _analyse(batch, last)


def analyse_planes(planes: DataFrame | Ordered) -> DataFrame:
    """Hashes of every plane and scores against the plane before it (null for the first).

    ``status`` is ``scored``, ``first`` or ``geometry_mismatch``. A media with many planes is
    chunked, and the last plane of each chunk goes into the next chunk too, as a halo row. Which
    planes those are is found from the index column alone, so plane data is read and shuffled once.
    """
    source = planes.df if isinstance(planes, Ordered) else planes
    good = valid_planes(source)
    if isinstance(planes, Ordered):
        o = planes.to(good)
    else:
        o = arrange(good, order=("presentation_index",), rows_per_chunk=min(chunk_rows(good), PLANES_PER_CHUNK))
    cols = ["media_id", "presentation_index", "width", "height", "data"]
    if not o.split:
        rows = o.df.select(*cols, F.lit(0).alias(CHUNK), F.lit(False).alias("_halo"))
    else:
        last = o.df.groupBy("media_id", CHUNK).agg(F.max("presentation_index").alias("presentation_index"))
        follows = last.select("media_id", "presentation_index", F.lead(CHUNK).over(o.chunks()).alias("_to"))
        own = F.struct(F.col(CHUNK).alias("chunk"), F.lit(False).alias("halo"))
        copy = F.struct(F.col("_to").alias("chunk"), F.lit(True).alias("halo"))
        places = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))
        rows = (
            o.df.join(follows.where("_to is not null"), ["media_id", "presentation_index"], "left")
            .withColumn("_p", F.explode(places))
            .select(*cols, F.col("_p.chunk").alias(CHUNK), F.col("_p.halo").alias("_halo"))
        )
    placed = rows.repartition("media_id", CHUNK).sortWithinPartitions("media_id", CHUNK, "presentation_index")
    return placed.mapInArrow(_kernel, RESULT)


def mismatched_planes(analysed: DataFrame) -> DataFrame:
    """Planes whose size differs from that of the plane before: what ``assemble_samples`` leaves out."""
    return analysed.where(F.col("status") == "geometry_mismatch").select("media_id", "presentation_index", "width", "height", "status")


def assemble_samples(analysed: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples table: analysed planes with the time, duration and key flag of their frames.

    Planes of another size than the one before have no scores; ``mismatched_planes`` reports them.
    """
    f = frames.where(F.col("pt_ns").isNotNull()).select(
        "media_id", "presentation_index", "pts", "pt_ns",
        F.greatest("duration_ns", F.lit(0)).alias("duration_ns"), "key_frame",
    )
    return (
        analysed.where(F.col("status") != "geometry_mismatch")
        .drop("status", "width", "height")
        .join(f, ["media_id", "presentation_index"])
    )


def analyse_ranges(
    planes: DataFrame, frames: DataFrame, ranges: DataFrame, preroll_ns: int = 1_000_000_000
) -> DataFrame:
    """Samples of closed ranges; planes from ``preroll_ns`` earlier give the first row a neighbour.

    One media may have several ranges, overlapping or not. Each plane of their union is hashed and
    compared once; a range takes those results where its own neighbour is the union's. The first row
    read for a range has no scores even when another range covers the frame before it, and a range
    whose times leave the order of the index has its other pairs compared apart. Only keys are
    copied per range, never planes.
    """
    f = frames.where(F.col("pt_ns").isNotNull())
    wide = ranges.select(
        "media_id", "range_id",
        F.greatest(F.least("start_ns", "end_ns"), F.lit(0)).alias("want_start"),
        F.greatest("start_ns", "end_ns").alias("want_end"),
    ).withColumn("read_start", F.greatest(F.col("want_start") - preroll_ns, F.lit(0)))
    picked = rows_in_ranges(
        f.select("media_id", "presentation_index", "pt_ns"), wide, "pt_ns", "read_start", "want_end"
    )
    sides = valid_planes(planes).select("media_id", "presentation_index", "width", "height")
    read = picked.select("media_id", "range_id", "presentation_index", (F.col("pt_ns") >= F.col("want_start")).alias("_wanted"))
    read = read.join(sides, ["media_id", "presentation_index"])
    own = arrange(read, keys=("media_id", "range_id"), order=("presentation_index",))
    rows = materialise(sequence(own, ["presentation_index", "width", "height"], pos=False, prev=True).plain())
    union = arrange(rows.select("media_id", "presentation_index").distinct(), order=("presentation_index",))
    steps = sequence(union, ["presentation_index"], pos=False, prev=True, names=("_pos", "_near", "_next")).plain()

    before = F.col("_prev.presentation_index")
    same_size = (F.col("_prev.width") == F.col("width")) & (F.col("_prev.height") == F.col("height"))
    status = F.when(before.isNull(), "first").when(same_size, "scored").otherwise("geometry_mismatch")
    rows = rows.where("_wanted").withColumn("status", status)
    rows = rows.join(steps, ["media_id", "presentation_index"])
    rows = rows.withColumn("_apart", (F.col("status") == "scored") & ~before.eqNullSafe(F.col("_near.presentation_index")))
    rows = rows.select("media_id", "range_id", "presentation_index", before.alias("_before"), "status", "_apart")

    once = analyse_planes(planes.join(steps.select("media_id", "presentation_index"), ["media_id", "presentation_index"], "left_semi"))
    out = rows.join(once.drop("status"), ["media_id", "presentation_index"])
    odd = _pairs_apart(planes, rows.where("_apart").select("media_id", "presentation_index", "_before").distinct())
    out = out.join(odd, ["media_id", "presentation_index", "_before"], "left")
    score = lambda c: F.when(F.col("status") == "scored", F.when(F.col("_apart"), F.col(f"_{c}")).otherwise(F.col(c)))
    out = out.withColumns({c: score(c) for c in SCORES}).drop("_before", "_apart", *[f"_{c}" for c in SCORES])
    return assemble_samples(out, frames)


def _pairs_apart(planes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores (as ``_motion`` and so on) of given pairs of frames (media_id, presentation_index, _before)."""
    named = pairs.withColumn("_pair", F.to_json(F.array("media_id", F.col("presentation_index").cast("string"), F.col("_before").cast("string"))))
    both = named.select("media_id", "_pair", F.explode(F.array("presentation_index", "_before")).alias("presentation_index"))
    cut = planes.join(both, ["media_id", "presentation_index"])
    analysed = analyse_planes(cut.drop("media_id").withColumnRenamed("_pair", "media_id"))
    scores = analysed.select(F.col("media_id").alias("_pair"), "presentation_index", *[F.col(c).alias(f"_{c}") for c in SCORES])
    return named.join(scores, ["_pair", "presentation_index"]).drop("_pair")


def equal_images(pairs: DataFrame) -> DataFrame:
    """pairs (a_*, b_*) + ``equal``: same geometry, same format, same packed bytes."""
    same = F.lit(True)
    for c in ("width", "height", "channels", "data"):
        same = same & F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    size = F.col("a_width").cast("bigint") * F.col("a_height") * F.col("a_channels")
    ok = F.coalesce((F.col("a_width") > 0) & (F.col("a_height") > 0) & (F.length("a_data") == size), F.lit(False))
    return pairs.withColumn("equal", same & ok)
