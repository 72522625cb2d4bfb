"""Labels, thresholds and presets of dataset selection."""

from __future__ import annotations

from dataclasses import dataclass, field

# Labels an evaluation may give.
VIEW_ANGLES = ["front", "three_quarter_left", "three_quarter_right", "profile_left", "profile_right", "back"]
SHOT_TYPES = ["closeup_face", "head_and_shoulders", "upper_body", "full_body", "other"]
GARMENT_TYPES = ["dress", "top", "bottom", "outerwear", "swimwear", "full_outfit", "other"]
POSE_CATEGORIES = ["standing", "sitting", "walking", "lying", "action", "kneeling", "other"]
CLARITIES = ["sharp", "slightly_soft", "blurry"]

#: Endings of image files.
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "webp", "bmp"]


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the quality gate."""

    min_side_fail: int = 512
    min_side_warn: int = 768
    sharpness_long_side: int = 1024
    processing_long_side: int = 1280
    global_sharpness_fail: float = 40.0
    global_sharpness_warn: float = 90.0
    face_sharpness_fail: float = 60.0
    face_sharpness_warn: float = 480.0
    face_area_warn: float = 0.015
    face_area_min: float = 0.004
    clip_warn: float = 0.35
    clip_worst: float = 0.8
    luma_low: float = 25.0
    luma_high: float = 232.0
    #: Score parts of images without a usable face.
    no_face: float = 0.6


@dataclass(frozen=True)
class DedupLimits:
    """Limits of near-duplicate detection."""

    cosine: float = 0.90
    hamming: int = 4
    hash_side: int = 16


@dataclass(frozen=True)
class CoverageLimits:
    """Limits of coverage and balancing."""

    min_total_sufficient: int = 25
    min_total_marginal: int = 15
    per_bucket_cap: int | None = None
    cap_min: int = 6
    cap_factor: float = 1.5
    min_suitability: int = 45
    soft_face_reject: bool = True
    soft_face_floor: float = 200.0
    soft_face_ratio: float = 0.45
    minimums: dict[str, int] = field(
        default_factory=lambda: {
            "front_face": 4, "profiles": 2, "three_quarter": 4, "full_body": 3, "distinct_views": 3,
            "body_visible": 8, "full_body_shots": 6, "pose_categories": 5, "pose_visible": 8,
            "garment_types": 3, "garment_visible": 8, "style_consistent": 10, "style_variety": 4,
        }
    )
