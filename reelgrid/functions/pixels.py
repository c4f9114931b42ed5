"""Numpy kernels over blocks of image planes of one geometry (rows x pixels, uint8)."""

from __future__ import annotations

import numpy as np

# 64-bit FNV-1a constants.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
BINS = 32
# Structural similarity block and constants (0.01*255)^2, (0.03*255)^2.
SSIM_BLOCK, SSIM_C1, SSIM_C2 = 8, 6.5025, 58.5225
LUMA = (0.2126, 0.7152, 0.0722)


def stack(planes, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), size)


def histogram(block: np.ndarray) -> np.ndarray:
    """32-bin histogram of every row, a cache-sized slice of rows at a time."""
    n, size = block.shape
    step = max(1, (1 << 20) // size)
    if n > step:
        return np.concatenate([histogram(block[i : i + step]) for i in range(0, n, step)])
    keys = (block >> 3).astype(np.int32) + (np.arange(n, dtype=np.int32) * BINS)[:, None]
    return np.bincount(keys.ravel(), minlength=n * BINS).reshape(n, BINS)


def content_hash(block: np.ndarray, width: int, height: int) -> np.ndarray:
    """FNV-1a over the pixels, then the bytes of width and height in turn, low byte first."""
    prime = np.uint64(FNV_PRIME)
    h = np.full(len(block), FNV_OFFSET, np.uint64)
    # Pixel positions in order; all rows advance together.
    for column in np.ascontiguousarray(block.T):
        np.bitwise_xor(h, column, out=h)
        np.multiply(h, prime, out=h)
    for shift in (0, 8, 16, 24):
        for side in (width, height):
            h ^= np.uint64((side >> shift) & 255)
            h *= prime
    return h.view(np.int64)


def _edges(side: int) -> list[tuple[int, int]]:
    out = []
    for k in range(8):
        lo = k * side // 8
        out.append((lo, min(max(lo + 1, (k + 1) * side // 8), side)))
    return out


def _span_sums(values: np.ndarray, axis: int, edges) -> np.ndarray:
    total = np.cumsum(values, axis=axis, dtype=np.int64)
    zero = np.zeros_like(np.take(total, [0], axis=axis))
    total = np.concatenate([zero, total], axis=axis)
    hi = np.take(total, [b for _, b in edges], axis=axis)
    lo = np.take(total, [a for a, _ in edges], axis=axis)
    return hi - lo


def perceptual_hash(block: np.ndarray, width: int, height: int) -> np.ndarray:
    """Row gradients of 8x8 block means in bits 0-55 and the mean of the blocks in bits 56-63."""
    n = len(block)
    ys, xs = _edges(height), _edges(width)
    image = block.reshape(n, height, width)
    sums = _span_sums(_span_sums(image, 2, xs), 1, ys)
    counts = np.outer([b - a for a, b in ys], [b - a for a, b in xs])
    means = sums // np.maximum(counts, 1)
    falls = (means[:, :, :7] >= means[:, :, 1:]).reshape(n, 56)
    bits = (falls.astype(np.uint64) << np.arange(56, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    level = (means.reshape(n, 64).sum(axis=1) // 64).astype(np.uint64) & np.uint64(255)
    return (bits | (level << np.uint64(56))).view(np.int64)


def pair_scores(motion_sum, overlap, hash_distance, size: int):
    """(motion, similarity, scene, duplicate) float32 from sums over pixels of a pair."""
    motion = np.clip(motion_sum / (255.0 * size), 0.0, 1.0)
    pixel = 1.0 - motion
    hist = np.clip(overlap / float(size), 0.0, 1.0)
    perceptual = 1.0 - hash_distance / 64.0
    similarity = np.clip(pixel * 0.8 + hist * 0.2, 0.0, 1.0)
    scene = np.clip(motion * 0.65 + (1.0 - hist) * 0.35, 0.0, 1.0)
    duplicate = np.clip(pixel * 0.6 + hist * 0.2 + np.minimum(pixel, perceptual) * 0.2, 0.0, 1.0)
    return tuple(x.astype(np.float32) for x in (motion, similarity, scene, duplicate))


def abs_difference_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of |a - b| per row, without leaving uint8."""
    step = max(1, (1 << 20) // a.shape[1])
    parts = [
        (np.maximum(a[i : i + step], b[i : i + step]) - np.minimum(a[i : i + step], b[i : i + step])).sum(axis=1, dtype=np.int64)
        for i in range(0, len(a), step)
    ]
    return np.concatenate(parts)


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint64)).astype(np.int64)


def area_scale(block: np.ndarray, width: int, height: int, out_w: int, out_h: int) -> np.ndarray:
    """Area-averaged gray planes of another size."""
    n = len(block)

    def weights(src: int, dst: int) -> np.ndarray:
        w = np.zeros((dst, src))
        step = src / dst
        for k in range(dst):
            lo, hi = k * step, (k + 1) * step
            for i in range(int(lo), min(int(np.ceil(hi)), src)):
                w[k, i] = max(0.0, min(hi, i + 1) - max(lo, i)) / step
        return w

    image = block.reshape(n, height, width).astype(np.float64)
    scaled = np.einsum("yh,nhw,xw->nyx", weights(height, out_h), image, weights(width, out_w), optimize=True)
    return np.clip(np.floor(scaled + 0.5), 0, 255).astype(np.uint8).reshape(n, out_w * out_h)


def gray(block: np.ndarray, channels: int) -> np.ndarray:
    """Luma of packed pixels as float64 (rows x pixels)."""
    if channels == 1:
        # The three equal components, weighted as a colour pixel is.
        v = block.astype(np.float64)
        return LUMA[0] * v + LUMA[1] * v + LUMA[2] * v
    rgb = block.reshape(len(block), -1, channels)[:, :, :3].astype(np.float64)
    return LUMA[0] * rgb[:, :, 0] + LUMA[1] * rgb[:, :, 1] + LUMA[2] * rgb[:, :, 2]


def squared_error(a: np.ndarray, b: np.ndarray, channels: int) -> np.ndarray:
    """Sum of squared differences over the three colour components."""
    n = len(a)
    d = a.reshape(n, -1, channels)[:, :, :3].astype(np.int32) - b.reshape(n, -1, channels)[:, :, :3]
    total = (d * d).reshape(n, -1).sum(axis=1, dtype=np.int64)
    return (total * 3 if channels == 1 else total).astype(np.float64)


def block_ssim(a: np.ndarray, b: np.ndarray, width: int, height: int, channels: int):
    """(score, pixels) per 8x8 block, blocks in row order; edge blocks are smaller."""
    n = len(a)
    x = gray(a, channels).reshape(n, height, width)
    y = gray(b, channels).reshape(n, height, width)
    rows = np.arange(0, height, SSIM_BLOCK)
    cols = np.arange(0, width, SSIM_BLOCK)

    def sums(v):
        return np.add.reduceat(np.add.reduceat(v, rows, axis=1), cols, axis=2)

    heights = np.minimum(rows + SSIM_BLOCK, height) - rows
    widths = np.minimum(cols + SSIM_BLOCK, width) - cols
    count = np.outer(heights, widths).astype(np.float64)
    mx, my = sums(x) / count, sums(y) / count
    vx = np.maximum(0.0, sums(x * x) / count - mx * mx)
    vy = np.maximum(0.0, sums(y * y) / count - my * my)
    cov = sums(x * y) / count - mx * my
    top = (2 * mx * my + SSIM_C1) * (2 * cov + SSIM_C2)
    bottom = (mx * mx + my * my + SSIM_C1) * (vx + vy + SSIM_C2)
    return np.clip(top / bottom, -1.0, 1.0), count
