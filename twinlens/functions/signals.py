"""Fused signals and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlens.config import CLASSIFIER, FEATURES, normalised


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def fuse(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Identity: the weighted sum of clipped signals."""
    w = normalised(weights or CLASSIFIER.weights)
    return reduce(lambda a, b: a + b, (clip(signals[k], 0.0, 1.0) * w[k] for k in w))


def feature_similarity(trusted: Column, inliers: Column, ratio: Column) -> Column:
    f = FEATURES
    score = F.least(F.lit(1.0), inliers / float(f.saturating_inliers)) * F.least(F.lit(1.0), ratio / f.ratio_strong)
    return F.when(trusted, score).otherwise(0.0)


def frame_agreement(source: Column, aspect: Column, cov_orig: Column, cov_cand: Column) -> Column:
    return F.when(source == "none", clip(0.9 * aspect, 0.0, 0.9)).otherwise(clip(cov_orig * cov_cand, 0.0, 1.0))


def identity_margin(identity: Column, threshold: float) -> Column:
    return (identity - threshold) / max(1e-6, 1.0 - threshold)


def confidence(margin: Column) -> Column:
    return 100.0 / (1.0 + F.exp(-CLASSIFIER.steepness * clip(margin, -1.5, 1.5)))
