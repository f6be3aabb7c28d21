"""Thresholds and weights. Fixed values, which results depend on."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class HashConfig:
    bits: int = 64
    work_size: int = 32
    weights: dict[str, float] = field(default_factory=lambda: {"phash": 0.45, "dhash": 0.25, "whash": 0.20, "ahash": 0.10})


@dataclass(frozen=True)
class FilterConfig:
    keep_hash_sim: float = 0.72
    keep_top_n: int = 24
    rescue_color_sim: float = 0.80
    rescue_hash_sim: float = 0.55
    hard_cap: int = 60
    low_size: int = 192
    work_size: int = 512
    compare_size: int = 256


@dataclass(frozen=True)
class PixelConfig:
    ssim_exact: float = 0.94
    ssim_near: float = 0.80
    ssim_similar: float = 0.45
    changed_exact: float = 0.04
    changed_near: float = 0.12
    block_epsilon: float = 6.0
    peak_epsilon: float = 18.0
    grid: int = 32


@dataclass(frozen=True)
class FeatureConfig:
    keypoints: int = 1200
    lowe_ratio: float = 0.75
    ransac_px: float = 4.0
    min_inliers: int = 15
    saturating_inliers: int = 40
    coverage_full: float = 0.90
    crop_max: float = 0.96
    crop_min_candidate: float = 0.75
    ratio_strong: float = 0.45
    template_score: float = 0.60
    scales: tuple[float, ...] = (0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)


@dataclass(frozen=True)
class EditConfig:
    gain_low: float = 0.90
    gain_high: float = 1.11
    offset: float = 5.0
    channel: float = 4.0
    sharpness: float = 0.72
    localised_ratio: float = 6.0
    localised_min: float = 0.004
    localised_max: float = 0.30
    border_min_area: float = 0.015
    border_band_std: float = 6.0


@dataclass(frozen=True)
class EmbeddingConfig:
    grid: int = 4
    hog_bins: int = 9


@dataclass(frozen=True)
class ClassifierConfig:
    weights: dict[str, float] = field(
        default_factory=lambda: {"hash_sim": 0.22, "ssim": 0.22, "nrmse_sim": 0.08, "grad_corr": 0.14, "emb_cos": 0.14, "feat_sim": 0.12, "hist_corr": 0.08}
    )
    identity_exact: float = 0.92
    identity_near: float = 0.84
    identity_similar: float = 0.55
    steepness: float = 7.0
    promote_share: float = 0.85


@dataclass(frozen=True)
class LimitConfig:
    upload_bytes: int = 32 << 20
    download_bytes: int = 24 << 20
    max_candidates: int = 400
    orientation_margin: float = 0.08


HASH, FILTER, PIXEL, FEATURES, EDITS = HashConfig(), FilterConfig(), PixelConfig(), FeatureConfig(), EditConfig()
EMBEDDING, CLASSIFIER, LIMITS = EmbeddingConfig(), ClassifierConfig(), LimitConfig()

# Label, is 1:1, group, rank, display, title.
LABELS = [
    ("EXACT_1TO1", True, "exact", 0, "1:1 MATCH", "EXACT 1:1 MATCHES"),
    ("NEAR_1TO1", True, "edited_resized", 1, "NEAR 1:1 MATCH", "EDITED / RESIZED 1:1 MATCHES"),
    ("EDITED_1TO1", True, "edited_resized", 1, "EDITED 1:1 MATCH", "EDITED / RESIZED 1:1 MATCHES"),
    ("CROP", False, "crops", 2, "CROP OF ORIGINAL", "CROPS"),
    ("VISUALLY_SIMILAR", False, "similar", 3, "SIMILAR IMAGE", "SIMILAR IMAGES"),
    ("UNRELATED", False, "unrelated", 4, "UNRELATED", "UNRELATED / LOW CONFIDENCE"),
    ("ERROR", False, "unrelated", 4, "COULD NOT VERIFY", "UNRELATED / LOW CONFIDENCE"),
]
UNKNOWN_RANK = 99
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff"]


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def thresholds() -> dict:
    """All values as nested dictionaries, weights normalised."""
    parts = {"hash": HASH, "filter": FILTER, "pixel": PIXEL, "features": FEATURES, "edits": EDITS, "embedding": EMBEDDING, "classifier": CLASSIFIER, "limits": LIMITS}
    out = {k: asdict(v) for k, v in parts.items()}
    for k in ("hash", "classifier"):
        out[k]["weights"] = normalised(out[k]["weights"])
    return out
