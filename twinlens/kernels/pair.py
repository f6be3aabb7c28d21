"""All measurements of one pair of images, and its rendering."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from twinlens.config import CLASSIFIER, FILTER, LIMITS
from twinlens.kernels import compare as C
from twinlens.kernels import geometry as G
from twinlens.kernels.pixels import color_histogram, descriptor, fitted, gray, hash_similarity, hash_size, hashes, resize, vector_cosine

NO_FEATURES = {"good": 0, "inliers": 0, "ratio": 0.0, "trusted": False, "transform": None, "coverage": None}
NO_TEMPLATE = {"score": -1.0, "direction": "none", "coverage": None, "region": None, "confident": False}


def _coverage(features: dict, template: dict) -> tuple[float, float, str]:
    f = features["coverage"] if features["trusted"] else None
    t = template["coverage"] if template["confident"] else None
    if f and t and abs(f["original"] - t["original"]) > 0.15:
        low = f if f["original"] <= t["original"] else t
        return low["original"], low["candidate"], "conservative-agreement"
    if f or t:
        c = f or t
        return c["original"], c["candidate"], "homography" if f else "template"
    return 0.0, 0.0, "none"


class Picture:
    """An image and what is made of it once, however many others it is compared with."""

    def __init__(self, rgb: np.ndarray, work: int = FILTER.work_size):
        self.rgb, self.work_size = rgb, work
        self.aspect = rgb.shape[1] / rgb.shape[0]
        self._stretched: dict[int, np.ndarray] = {}

    small = cached_property(lambda self: hash_size(self.rgb))
    hashes = cached_property(lambda self: hashes(self.small))
    color_hist = cached_property(lambda self: color_histogram(self.small))
    work = cached_property(lambda self: fitted(self.rgb, self.work_size))
    keypoints = cached_property(lambda self: G.keypoints(gray(self.work)))
    descriptor = cached_property(lambda self: descriptor(self.work))
    bands = cached_property(lambda self: C.flat_bands(self.rgb))
    scene = cached_property(lambda self: G.Scene(self.work, min(256, self.work_size)))

    def stretched(self, size: int) -> np.ndarray:
        if size not in self._stretched:
            self._stretched[size] = resize(self.rgb, size, size)
        return self._stretched[size]


def compared(a: Picture, b: Picture, size: int, deep: bool):
    """Both in one frame: the candidate as turned, both canvases, how they were aligned, and the geometry."""
    turned, b = G.best_orientation(a, b, LIMITS.orientation_margin)
    features = G.match_features(a.keypoints, b.keypoints, a.work.shape[1::-1], b.work.shape[1::-1]) if deep else NO_FEATURES
    template = G.locate(a.scene, b.scene) if deep else NO_TEMPLATE
    x, y, method, valid = G.align(a.work, b.work, features, template, size)
    return turned, b, features, template, x, y, method, valid


def signals(a: Picture | np.ndarray, b: Picture | np.ndarray, sha_a: str = "", sha_b: str = "", work: int = FILTER.work_size, size: int = FILTER.compare_size, deep: bool = True) -> dict:
    """The signals of a pair, named as in SIGNAL. ``deep`` adds keypoints and template search."""
    a, b = (x if isinstance(x, Picture) else Picture(x, work) for x in (a, b))
    turned, b, features, template, x, y, method, valid = compared(a, b, size, deep)
    cov_o, cov_c, source = _coverage(features, template)
    m = C.measure_edits(x, y)
    border, share = C.border_share(b.bands, a.aspect)
    sims = {k: hash_similarity({k: a.hashes[k]}, {k: b.hashes[k]}, {k: 1.0}) for k in a.hashes}
    overall = hash_similarity(a.hashes, b.hashes)
    aligned = hash_similarity(hashes(hash_size(x)), hashes(hash_size(y))) if method in ("homography", "template") else 0.0
    feat = min(1.0, features["inliers"] / 40) * min(1.0, features["ratio"] / 0.45) if features["trusted"] else 0.0
    best = max(sims, key=sims.get)
    return {
        "sha_identical": bool(sha_a) and sha_a == sha_b,
        "orientation": turned,
        "aspect_sim": min(a.aspect, b.aspect) / max(a.aspect, b.aspect),
        "hash_sim": max(overall, aligned),
        "hash_sim_global": overall,
        "hash_sim_aligned": aligned,
        "hash_best": sims[best],
        "hash_worst": min(sims.values()),
        "hash_best_name": best,
        "hist_corr": vector_cosine(a.color_hist, b.color_hist),
        "emb_cos": vector_cosine(a.descriptor, b.descriptor),
        "feat_sim": feat,
        "ssim": C.ssim(x, y),
        "ms_ssim": C.ms_ssim(x, y),
        "ssim_raw": C.ssim(a.stretched(size), b.stretched(size)),
        "nrmse_sim": C.nrmse_similarity(x, y),
        "psnr": C.psnr(x, y),
        "grad_corr": C.gradient_correlation(x, y),
        "inliers": features["inliers"],
        "inlier_ratio": features["ratio"],
        "trusted": features["trusted"],
        "template_score": template["score"],
        "template_direction": template["direction"],
        "coverage_orig": cov_o,
        "coverage_cand": cov_c,
        "coverage_source": source,
        "align_method": method,
        "align_valid_fraction": valid,
        "changed_fraction": m["changed"],
        "localised_fraction": m["localised"],
        "gain": m["gain"],
        "offset": m["offset"],
        "linear_r2": m["fit"],
        "residual": m["residual"],
        "channel_shift": m["shift"],
        "sharpness_ratio": m["sharpness"],
        "border": border,
        "border_fraction": share,
    }


def summary(rgb: np.ndarray, size: int = 112) -> dict:
    """What ``quick_pair`` needs of an image, made once an image and small enough to be sent along with pairs."""
    p = Picture(rgb)
    return p.hashes | {"color_hist": p.color_hist, "thumb": p.stretched(size), "aspect": p.aspect} | p.bands


def quick_pair(a: dict, b: dict) -> dict:
    """A cheap comparison of two candidates as they are, by their summaries: no orientation, keypoints or template.
    A border is looked for in the second, against the shape of the first."""
    x, y = a["thumb"], b["thumb"]
    m = C.measure_edits(x, y)
    border, _ = C.border_share(b, a["aspect"])
    border = border or C.find_border(y, x.shape[1] / x.shape[0])[0]
    w = CLASSIFIER.weights
    part = {
        "hash_sim": hash_similarity(a, b),
        "ssim": C.ssim(x, y),
        "nrmse_sim": C.nrmse_similarity(x, y),
        "grad_corr": C.gradient_correlation(x, y),
        "hist_corr": vector_cosine(a["color_hist"], b["color_hist"]),
    }
    identity = sum(w[k] * float(np.clip(v, 0, 1)) for k, v in part.items()) / sum(w[k] for k in part)
    return {
        "identity": identity,
        "ssim": part["ssim"],
        "changed_fraction": m["changed"],
        "hash_sim": part["hash_sim"],
        "edit_labels": [n for n in C.edit_names(C.edit_flags(m, border)) if n != "recompressed"],
    }


def _heat(v: np.ndarray) -> np.ndarray:
    """0..255 to a dark-violet-orange-yellow ramp."""
    # Colours at equal steps.
    stops = np.array([(0, 0, 4), (40, 11, 84), (101, 21, 110), (159, 42, 99), (212, 72, 66), (245, 125, 21), (250, 193, 39), (252, 255, 164)], dtype=float)
    at = np.linspace(0, 255, len(stops))
    return np.stack([np.interp(v, at, stops[:, c]) for c in range(3)], axis=-1).astype(np.uint8)


def render(a: np.ndarray, b: np.ndarray, size: int = 720) -> dict:
    """Both images in one frame, their difference four times as strong, and a heat map of it."""
    _, _, features, template, x, y, method, valid = compared(Picture(a), Picture(b), size, True)
    cov_o, cov_c, _ = _coverage(features, template)
    delta = np.abs(x.astype(np.float32) - y.astype(np.float32))
    return {
        "original": x,
        "candidate": y,
        "difference": np.clip(4 * delta, 0, 255).astype(np.uint8),
        "heatmap": _heat(np.clip(6 * gray(delta), 0, 255)),
        "align_method": method,
        "align_valid_fraction": valid,
        "coverage_orig": cov_o,
        "coverage_cand": cov_c,
        "size": size,
    }
