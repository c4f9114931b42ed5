"""Parameters of the operators. All times are nanoseconds."""

from __future__ import annotations

from dataclasses import dataclass, replace

MS = 1_000_000
SECOND = 1_000_000_000

# Order of frames inside one media: time, then index, then stream timestamp.
FRAME_ORDER = ("pt_ns", "presentation_index", "pts")


def _clamp(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class DetectionConfig:
    scene_threshold: float = 0.45
    scene_separation_ns: int = 250 * MS
    near_duplicate_threshold: float = 0.985
    freeze_threshold: float = 0.995
    freeze_duration_ns: int = 500 * MS
    duplicate_frames: int = 2
    freeze_frames: int = 3
    repeated_frames: int = 3
    repeated_separation_ns: int = 2 * SECOND
    perceptual_distance: int = 4
    fingerprint_candidates: int = 8  # part of the rule: earlier positions of a hash that a section may repeat
    results_per_kind: int | None = None  # no limit

    def normalized(self) -> "DetectionConfig":
        return replace(
            self,
            scene_threshold=_clamp(self.scene_threshold, 0.0, 1.0),
            near_duplicate_threshold=_clamp(self.near_duplicate_threshold, 0.0, 1.0),
            freeze_threshold=_clamp(self.freeze_threshold, 0.0, 1.0),
            scene_separation_ns=max(0, self.scene_separation_ns),
            freeze_duration_ns=max(0, self.freeze_duration_ns),
            repeated_separation_ns=max(0, self.repeated_separation_ns),
            duplicate_frames=max(2, self.duplicate_frames),
            freeze_frames=max(2, self.freeze_frames),
            repeated_frames=max(2, self.repeated_frames),
            perceptual_distance=min(64, self.perceptual_distance),
            fingerprint_candidates=max(1, self.fingerprint_candidates),
            results_per_kind=None if self.results_per_kind is None else max(0, self.results_per_kind),
        )


@dataclass(frozen=True)
class LodConfig:
    base_buckets: int = 262_144
    grouping: int = 4
    levels: int = 16

    def normalized(self) -> "LodConfig":
        return LodConfig(max(1, self.base_buckets), _clamp(self.grouping, 2, 16), max(1, self.levels))


@dataclass(frozen=True)
class HeatmapWeights:
    motion: float = 0.5
    similarity: float = 0.3
    scene: float = 0.2


# Versions stored with samples; rows of another version are not visible.
SCHEMA_VERSION = 2
ALGORITHM_VERSION = 2
