"""Score expressions and frame predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HeatmapWeights


def unit(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return 1.0 - hamming(a, b) / F.lit(64.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    # BT.709 luma weights.
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def combined_score(
    motion: Column, difference: Column, scene: Column, weights: HeatmapWeights = HeatmapWeights()
) -> Column:
    """Weighted mean of the components that are present, in single precision; null if none."""
    parts = [
        (component, max(0.0, weight))
        for component, weight in zip(
            (motion, difference, scene), (weights.motion, weights.similarity, weights.scene)
        )
        if weight > 0.0
    ]
    zero = F.lit(0.0).cast("float")
    if not parts:
        return F.lit(None).cast("float")
    f32 = [(c, F.lit(w).cast("float")) for c, w in parts]
    total = reduce(
        lambda acc, cw: acc + F.when(cw[0].isNotNull(), cw[1] * unit(cw[0])).otherwise(zero), f32, zero
    )
    active = reduce(
        lambda acc, cw: acc + F.when(cw[0].isNotNull(), cw[1]).otherwise(zero), f32, zero
    )
    return F.when(active > 0, unit((total / active).cast("float")))


def heatmap_average(
    mode: Column | str, bucket: dict[str, Column], weights: HeatmapWeights = HeatmapWeights()
) -> Column:
    """Average bucket score by mode: motion, similarity, scene or combined."""
    present = {k: F.when(bucket[f"{k}_count"] > 0, bucket[f"{k}_avg"]) for k in ("motion", "similarity", "scene")}
    one = F.lit(1.0).cast("float")
    return _by_mode(
        mode,
        present,
        combined_score(present["motion"], one - present["similarity"], present["scene"], weights),
    )


def heatmap_peak(
    mode: Column | str, bucket: dict[str, Column], weights: HeatmapWeights = HeatmapWeights()
) -> Column:
    """Largest bucket score by mode; combined takes the least similarity as a difference."""
    present = {k: F.when(bucket[f"{k}_count"] > 0, bucket[f"{k}_max"]) for k in ("motion", "similarity", "scene")}
    least = F.when(bucket["similarity_count"] > 0, bucket["similarity_min"])
    one = F.lit(1.0).cast("float")
    return _by_mode(mode, present, combined_score(present["motion"], one - least, present["scene"], weights))


def _by_mode(mode: Column | str, single: dict[str, Column], combined: Column) -> Column:
    if isinstance(mode, str):
        return combined if mode == "combined" else single[mode]
    return (
        F.when(mode == "motion", single["motion"])
        .when(mode == "similarity", single["similarity"])
        .when(mode == "scene", single["scene"])
        .when(mode == "combined", combined)
    )


def high_motion(motion: Column, threshold: float = 0.70) -> Column:
    return motion >= F.lit(threshold).cast("float")


def in_range(time: Column, start: Column, end: Column) -> Column:
    """Closed range; the ends may come in any order."""
    return time.between(F.least(start, end), F.greatest(start, end))


def valid_score(score: Column) -> Column:
    return score.isNull() | (~F.isnan(score) & score.between(0.0, 1.0))
