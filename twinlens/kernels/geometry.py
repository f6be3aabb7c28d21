"""Where one image lies in another: polygons, keypoints, transforms, template search."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from twinlens.config import FEATURES
from twinlens.kernels.pixels import ORIENTATIONS, _lanczos_single, fit, gray, hash_similarity, hash_size, hashes, orient, resize, resize_plane


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _follow(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The next corner of each corner; polygons are rows of ``count`` corners, padded."""
    nxt = np.arange(1, p.shape[1] + 1)[None, :] * np.ones((len(p), 1), dtype=int)
    nxt[nxt >= count[:, None]] = 0
    return np.take_along_axis(p, nxt[..., None], axis=1)


def signed_areas(p: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """Areas of polygons (rows x corners x 2), negative if they turn the other way."""
    count = np.full(len(p), p.shape[1]) if count is None else count
    real = np.arange(p.shape[1]) < count[:, None]
    return np.where(real, _cross(p, _follow(p, count)), 0).sum(axis=1) / 2


def polygon_area(p: np.ndarray) -> float:
    return float(abs(signed_areas(np.asarray(p, dtype=float)[None])[0])) if len(p) >= 3 else 0.0


def convex_intersections(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What convex polygons ``p`` and ``q`` (rows x corners x 2) have in common, row by row at once: padded corners and
    their numbers. The sides of ``q`` cut ``p`` one after the other."""
    p, q = (np.where(signed_areas(x)[:, None, None] < 0, x[:, ::-1], x).astype(float) for x in (p, q))
    count = np.full(len(p), p.shape[1])
    for e in range(q.shape[1]):
        a, b = q[:, e, None], q[:, (e + 1) % q.shape[1], None]
        inside = _cross(b - a, p - a)
        ahead, beyond = _follow(p, count), _follow(inside[..., None], count)[..., 0]
        real = np.arange(p.shape[1]) < count[:, None]
        cuts = real & ((inside >= 0) != (beyond >= 0))
        t = inside / np.where(cuts, inside - beyond, 1)
        corners = np.stack((p, p + (ahead - p) * t[..., None]), axis=2).reshape(len(p), -1, 2)
        keep = np.stack((real & (inside >= 0), cuts), axis=2).reshape(len(p), -1)
        count = keep.sum(axis=1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, count.max(initial=0))]
        p = np.take_along_axis(corners, order[..., None], axis=1)
    return p, count


def clip_polygon(p: np.ndarray, width: float, height: float) -> np.ndarray:
    """The part of a convex polygon inside the rectangle from the origin."""
    frame = np.array([[0, 0], [width, 0], [width, height], [0, height]], dtype=float)
    got, count = convex_intersections(np.asarray(p, dtype=float)[None], frame[None])
    return got[0, : count[0]]


def _frames(size: np.ndarray) -> np.ndarray:
    return np.asarray(size, dtype=float)[:, None, :] * np.array([[0, 0], [1, 0], [1, 1], [0, 1]])


def coverages(m: np.ndarray, size_orig: np.ndarray, size_cand: np.ndarray) -> dict[str, np.ndarray]:
    """Coverage of 3 x 3 transforms (rows x 3 x 3) from originals to candidates of these sizes (rows x 2): the shares of both
    that meet, the corners of the original's image, the scale, and whether the transform degenerates (``bad``)."""
    size_orig, size_cand = np.asarray(size_orig, dtype=float), np.asarray(size_cand, dtype=float)
    flat = _frames(size_orig)
    with np.errstate(all="ignore"):
        h = np.concatenate((flat, np.ones_like(flat[..., :1])), axis=-1) @ np.swapaxes(np.asarray(m, dtype=float), -1, -2)
        p = h[..., :2] / h[..., 2:]
        area = np.abs(signed_areas(p))
        bad = ~np.isfinite(h).all(axis=(1, 2)) | (np.abs(h[..., 2]) < 1e-9).any(axis=1) | ~np.isfinite(area) | (area < 1e-6)
    p = np.where(bad[:, None, None], flat, p)
    common, count = convex_intersections(p, _frames(size_cand))
    overlap = np.abs(signed_areas(common, count))
    area = np.where(bad, 1.0, area)
    return {
        "original": np.clip(overlap / area, 0, 1),
        "candidate": np.clip(overlap / size_cand.prod(axis=1), 0, 1),
        "corners": p,
        "scale": np.sqrt(area / size_orig.prod(axis=1)),
        "bad": bad,
    }


def coverage_of_transform(m: np.ndarray, size_orig: tuple[int, int], size_cand: tuple[int, int]) -> dict | None:
    """Coverage of one transform; None if it degenerates."""
    c = coverages(np.asarray(m)[None], np.array([size_orig]), np.array([size_cand]))
    if c["bad"][0]:
        return None
    p = c["corners"][0]
    return {"original": float(c["original"][0]), "candidate": float(c["candidate"][0]), "box": [*p.min(axis=0).tolist(), *p.max(axis=0).tolist()], "scale": float(c["scale"][0])}


# ---- keypoints -------------------------------------------------------------------------------------

_CIRCLE = np.array([(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)])
_EDGE = 19


@lru_cache(maxsize=1)
def _pattern() -> np.ndarray:
    """256 pairs of offsets within the patch, drawn once."""
    return np.clip(np.random.default_rng(11).normal(0, 6.2, (256, 2, 2)), -13, 13)


def _smooth(g: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-5, 6) / sigma) ** 2).astype(np.float32)
    k /= k.sum()
    p = np.pad(g, 5, mode="edge")
    p = sum(w * p[:, i : i + g.shape[1]] for i, w in enumerate(k))
    return sum(w * p[i : i + g.shape[0]] for i, w in enumerate(k))


def _corners(g: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """(x, y) of corners: nine in a row of the sixteen around are all brighter or all darker."""
    h, w = g.shape
    if h <= 2 * _EDGE or w <= 2 * _EDGE:
        return np.zeros((0, 2), dtype=int)
    inner = g[_EDGE : h - _EDGE, _EDGE : w - _EDGE]
    # nine in a row hold two at least of the four a quarter turn apart: most places fail that
    quarter = [g[_EDGE + dy : h - _EDGE + dy, _EDGE + dx : w - _EDGE + dx] - inner for dx, dy in _CIRCLE[::4]]
    few = np.zeros(inner.shape, dtype=bool)
    for sign in (1, -1):
        few |= sum((sign * q > threshold).view(np.uint8) for q in quarter) >= 2
    ys, xs = np.nonzero(few)
    if not len(ys):
        return np.zeros((0, 2), dtype=int)
    flat = (ys + _EDGE) * w + xs + _EDGE
    ring = g.ravel()[flat + (_CIRCLE[:, 1] * w + _CIRCLE[:, 0])[:, None]] - inner[ys, xs]
    hit = np.zeros(len(ys), dtype=bool)
    for mask in (ring > threshold, ring < -threshold):
        run = np.concatenate((mask, mask[:8]))
        ok = run[:-1] & run[1:]
        ok = ok[:-2] & ok[2:]  # four
        ok = ok[:-4] & ok[4:]  # eight
        hit |= (ok[:16] & run[8:24]).any(axis=0)
    score = np.zeros((inner.shape[0] + 2, inner.shape[1] + 2), dtype=ring.dtype)
    ys, xs, own = ys[hit], xs[hit], np.abs(ring[:, hit]).sum(axis=0)
    score[ys + 1, xs + 1] = own
    around = np.stack([score[ys + 1 + dy, xs + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    peak = own >= around.max(axis=0) if len(ys) else np.zeros(0, dtype=bool)
    ys, xs, own = ys[peak], xs[peak], own[peak]
    best = np.argsort(-own, kind="stable")[:most]
    return np.stack((xs[best] + _EDGE, ys[best] + _EDGE), axis=1)


def keypoints(g: np.ndarray, most: int = FEATURES.keypoints, levels: int = 8, step: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Places in the full image and 256-bit binary descriptors (four words) of oriented corners."""
    places, words = [], []
    share = np.array([step ** (-2 * k) for k in range(levels)])
    share = np.ceil(most * share / share.sum()).astype(int)
    yy, xx = np.mgrid[-15:16, -15:16]
    disc = (xx * xx + yy * yy <= 225).astype(np.float32)
    for k in range(levels):
        w, h = round(g.shape[1] / step**k), round(g.shape[0] / step**k)
        if min(w, h) <= 2 * _EDGE + 2:
            break
        level = g if k == 0 else _lanczos_single(g.shape[0], h) @ g @ _lanczos_single(g.shape[1], w).T
        xy = _corners(level, 8.0, int(share[k]))
        if not len(xy):
            continue
        patch = level[xy[:, 1, None, None] + yy, xy[:, 0, None, None] + xx] * disc
        angle = np.arctan2((patch * yy).sum(axis=(1, 2)), (patch * xx).sum(axis=(1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        off = _pattern()
        dx = np.rint(off[None, :, :, 0] * c - off[None, :, :, 1] * s).astype(int)
        dy = np.rint(off[None, :, :, 0] * s + off[None, :, :, 1] * c).astype(int)
        soft = _smooth(level)
        v = soft[np.clip(xy[:, 1, None, None] + dy, 0, h - 1), np.clip(xy[:, 0, None, None] + dx, 0, w - 1)]
        bits = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)
        words.append(np.ascontiguousarray(bits).view(np.uint64))
        places.append((xy + 0.5) * [g.shape[1] / w, g.shape[0] / h] - 0.5)
    if not places:
        return np.zeros((0, 2)), np.zeros((0, 4), dtype=np.uint64)
    return np.concatenate(places), np.concatenate(words)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares turn, scale and shift from a to b, as complex numbers (z, t)."""
    p, q = a[..., 0] + 1j * a[..., 1], b[..., 0] + 1j * b[..., 1]
    pm, qm = p.mean(axis=-1, keepdims=True), q.mean(axis=-1, keepdims=True)
    den = (np.abs(p - pm) ** 2).sum(axis=-1)
    z = (np.conj(p - pm) * (q - qm)).sum(axis=-1) / np.where(den > 1e-9, den, np.inf)
    return np.stack((z, qm[..., 0] - z * pm[..., 0]), axis=-1)


def _samples(n: int, size: int, rounds: int) -> np.ndarray:
    """Rows of ``size`` different numbers below ``n``."""
    rng = np.random.default_rng(5)
    pick = rng.integers(0, n - np.arange(size), (rounds, size))
    for k in range(1, size):
        # a draw from those left: step over the ones taken before, in their order
        for taken in np.sort(pick[:, :k], axis=1).T:
            pick[:, k] += pick[:, k] >= taken
    return pick


def agreed_similarity(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray | None, int]:
    """The turn, scale and shift that most matches agree on, and their number; None if no two matches give one."""
    p, q = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    pick = _samples(len(a), 2, 4000)
    pick = pick[np.abs(p[pick[:, 0]] - p[pick[:, 1]]) > 1e-6]
    if not len(pick):
        return None, 0
    models = _similarity(a[pick], b[pick])
    votes = np.concatenate([(np.abs(x[:, :1] * p + x[:, 1:] - q) < reach).sum(axis=1) for x in np.array_split(models, 8)])
    z, t = models[votes.argmax()]
    for _ in range(3):
        inside = np.abs(z * p + t - q) < reach
        if inside.sum() < 2:
            break
        z, t = _similarity(a[inside], b[inside])
    inliers = int((np.abs(z * p + t - q) < reach).sum())
    return np.array([[z.real, -z.imag, t.real], [z.imag, z.real, t.imag], [0, 0, 1]]), inliers


def _homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares projective transforms from a to b (the last two axes are matches and x, y)."""

    def unit(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(axis=-2, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - c) ** 2).sum(axis=-1)).mean(axis=-1), 1e-9)
        m = np.zeros((*p.shape[:-2], 3, 3))
        m[..., 0, 0] = m[..., 1, 1] = s
        m[..., :2, 2] = -s[..., None] * c[..., 0, :]
        m[..., 2, 2] = 1
        return (p - c) * s[..., None, None], m

    (u, mu), (v, mv) = unit(a), unit(b)
    one = np.concatenate((u, np.ones_like(u[..., :1])), axis=-1)
    zero = np.zeros_like(one)
    lines = np.concatenate(
        (np.concatenate((one, zero, -v[..., :1] * one), axis=-1), np.concatenate((zero, one, -v[..., 1:] * one), axis=-1)), axis=-2
    )
    h = np.linalg.svd(lines)[2][..., -1, :].reshape(*a.shape[:-2], 3, 3)
    return np.linalg.inv(mv) @ h @ mu


def agreed_homography(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray | None, int]:
    """The projective transform that most matches agree on, and their number; None if four don't."""
    p = np.concatenate((a, np.ones((len(a), 1))), axis=1)

    def inside(m: np.ndarray) -> np.ndarray:
        x = p @ np.swapaxes(m, -1, -2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x[..., :2] / x[..., 2:] - b) ** 2).sum(axis=-1) < reach * reach

    pick = _samples(len(a), 4, 2000)
    models = _homography(a[pick], b[pick])
    votes = np.concatenate([inside(x).sum(axis=1) for x in np.array_split(models, 8)])
    m = models[votes.argmax()]
    for _ in range(3):
        agree = inside(m)
        if agree.sum() < 4:
            return None, 0
        m = _homography(a[agree], b[agree])
    if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
        return None, 0
    return m, int(inside(m).sum())


def match_features(of_a: tuple, of_b: tuple, size_a: tuple[int, int], size_b: tuple[int, int]) -> dict:
    """The keypoints of two images matched by ratio test and a transform agreed on by most of them."""
    f = FEATURES
    none = {"good": 0, "inliers": 0, "ratio": 0.0, "trusted": False, "transform": None, "coverage": None}
    (pa, da), (pb, db) = of_a, of_b
    if len(pa) < 8 or len(pb) < 8:
        return none
    dist = np.zeros((len(da), len(db)), dtype=np.uint16)
    for k in range(4):
        dist += np.bitwise_count(da[:, None, k] ^ db[None, :, k])
    two = np.argpartition(dist, 1, axis=1)[:, :2]
    d2 = np.sort(np.take_along_axis(dist, two, axis=1), axis=1)
    first = dist.argmin(axis=1)
    good = d2[:, 0] < f.lowe_ratio * d2[:, 1]
    a, b = pa[good], pb[first[good]]
    if len(a) < 8:
        return none | {"good": len(a)}
    m, inliers = agreed_similarity(a, b, f.ransac_px)
    if m is None:
        m, inliers = agreed_homography(a, b, f.ransac_px)
    if m is None:
        return none | {"good": len(a)}
    coverage = coverage_of_transform(m, size_a, size_b)
    trusted = inliers >= f.min_inliers and coverage is not None
    return {"good": len(a), "inliers": inliers, "ratio": inliers / max(1, min(len(a), f.saturating_inliers)), "trusted": trusted, "transform": m, "coverage": coverage}


# ---- template search --------------------------------------------------------------------------------


def _standard(g: np.ndarray) -> np.ndarray:
    s = g.std()
    return np.zeros_like(g) if s < 1e-6 else (g - g.mean()) / s


def scales() -> np.ndarray:
    """A geometric ladder with twice the listed steps."""
    lo, hi = FEATURES.scales[0], FEATURES.scales[-1]
    return np.geomspace(lo, hi, 2 * len(FEATURES.scales))


def _fast_length(n: int) -> int:
    """The least length from ``n`` on with no other prime factors than 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


class Scene:
    """An image at search size, with its transform and sums, to be searched by any number of templates; and as a
    template at all scales."""

    def __init__(self, rgb: np.ndarray, work: int):
        self.rgb = rgb
        self.size = fit(rgb.shape[1], rgb.shape[0], work)
        plain = gray(resize(rgb, *self.size)).astype(np.float64)
        self.plane, self.plain = _standard(plain), plain
        # positions where the template lies wholly inside never wrap around
        self.shape = [_fast_length(n) for n in self.plane.shape]
        self.transform = np.fft.rfft2(self.plane, self.shape)
        self.sums = [np.pad(np.cumsum(np.cumsum(x, axis=0), axis=1), ((1, 0), (1, 0))) for x in (self.plane, self.plane * self.plane)]
        self._scaled: dict[float, np.ndarray] = {}

    def scaled(self, k: float) -> np.ndarray:
        """This image as a template at one scale, without its mean."""
        if k not in self._scaled:
            w, h = (max(8, round(n * k)) for n in self.size)
            t = _standard(resize_plane(self.plain, w, h))
            self._scaled[k] = t - t.mean()
        return self._scaled[k]

    def correlate(self, t: np.ndarray) -> np.ndarray:
        """Normalised correlation of a template at all places inside."""
        h, w = t.shape
        rows, cols = self.plane.shape
        num = np.fft.irfft2(self.transform * np.conj(np.fft.rfft2(t, self.shape)), self.shape)[: rows - h + 1, : cols - w + 1]
        total, squares = (s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w] for s in self.sums)
        den = np.sqrt(np.maximum(squares - total * total / (h * w), 0) * (t * t).sum())
        return np.where(den > 1e-6, num / np.maximum(den, 1e-6), 0.0)


def find_template(template: Scene, scene: Scene) -> tuple[float, list[float] | None]:
    """Best score over scales and places, and the box in the scene's own pixels."""
    (sw, sh), best, box = scene.size, -1.0, None
    across, down = scene.rgb.shape[1] / sw, scene.rgb.shape[0] / sh
    for k in scales().tolist():
        t = template.scaled(k)
        h, w = t.shape
        if w > sw or h > sh:
            continue
        r = scene.correlate(t)
        i = int(r.argmax())
        if r.flat[i] > best:
            best, (y, x) = float(r.flat[i]), np.unravel_index(i, r.shape)
            box = [x * across, y * down, (x + w) * across, (y + h) * down]
    return best, box


def locate(a: Scene, b: Scene) -> dict:
    """Search each image in the other; the original in the candidate wins ties."""
    (fwd, fbox), (rev, rbox) = find_template(a, b), find_template(b, a)
    ahead = fwd >= rev
    score, box, host = (fwd, fbox, b.rgb) if ahead else (rev, rbox, a.rgb)
    out = {"score": score, "direction": "original-in-candidate" if ahead else "candidate-in-original", "coverage": None, "region": None, "confident": score >= FEATURES.template_score}
    if box is None:
        return out | {"direction": "none", "confident": False}
    x0, y0, x1, y1 = (int(round(v)) for v in box)
    h, w = host.shape[:2]
    inside = max(0, min(x1, w) - max(x0, 0)) * max(0, min(y1, h) - max(y0, 0))
    share = inside / (w * h)
    cov = {"original": inside / max(1, (x1 - x0) * (y1 - y0)), "candidate": share} if ahead else {"original": share, "candidate": 1.0}
    return out | {"coverage": cov, "region": host[max(0, y0) : min(h, y1), max(0, x0) : min(w, x1)]}


def warp_into_original(size: tuple[int, int], candidate: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate seen in the original's frame (bilinear), and where it has pixels."""
    w, h = size
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    p = np.stack((x, y, np.ones_like(x)), axis=-1) @ m.T
    u, v = p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]
    ch, cw = candidate.shape[:2]
    mask = (u > -0.5) & (u < cw - 0.5) & (v > -0.5) & (v < ch - 0.5)
    u, v = np.clip(u, 0, cw - 1), np.clip(v, 0, ch - 1)
    x0, y0 = np.minimum(u.astype(int), max(0, cw - 2)), np.minimum(v.astype(int), max(0, ch - 2))
    fx, fy = (u - x0)[..., None], (v - y0)[..., None]
    x1, y1 = np.minimum(x0 + 1, cw - 1), np.minimum(y0 + 1, ch - 1)
    top = candidate[y0, x0] * (1 - fx) + candidate[y0, x1] * fx
    low = candidate[y1, x0] * (1 - fx) + candidate[y1, x1] * fx
    out = np.rint(top * (1 - fy) + low * fy).astype(np.uint8)
    out[~mask] = 0
    return out, mask


def align(a: np.ndarray, b: np.ndarray, features: dict, template: dict, size: int) -> tuple[np.ndarray, np.ndarray, str, float]:
    """Both images in one frame of size x size: as they are if they cover each other, by the trusted
    transform, by the confident template, or stretched."""

    def pair(x: np.ndarray, y: np.ndarray):
        return resize(x, size, size), resize(y, size, size)

    if features["trusted"]:
        cov = features["coverage"]
        if cov["original"] >= 0.98 and cov["candidate"] >= 0.98:
            return *pair(a, b), "coextensive", 1.0
        warped, mask = warp_into_original((a.shape[1], a.shape[0]), b, features["transform"])
        ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if len(ys) >= 16 and len(xs) >= 16:
            part = slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1)
            return *pair(a[part], warped[part]), "homography", float(mask.mean())
    region = template["region"]
    if template["confident"] and region is not None and region.size:
        return (*pair(a, region), "template", 1.0) if template["direction"] == "original-in-candidate" else (*pair(region, b), "template", 1.0)
    return *pair(a, b), "none", 1.0


def best_orientation(a, b, margin: float):
    """Of eight orientations of picture ``b`` the one whose hashes are closest to those of ``a``, by a margin; a template search
    may send it back to the identity. Hashes are made from the whole image; those of mirrored and half-turned images
    from the same reduction, as it has no side."""
    aside = hash_size(orient(b.rgb, "rot90"))
    sims = []
    for name in ORIENTATIONS:
        if name.endswith(("rot90", "rot270")):  # seen from the quarter turn
            flip = {"rot90": "identity", "rot270": "rot180", "mirror-h-rot90": "mirror-h-rot180", "mirror-h-rot270": "mirror-h"}[name]
            small = orient(aside, flip)
        else:
            small = orient(b.small, name)
        sims.append(hash_similarity(a.hashes, hashes(small)))
    k = int(np.argmax(sims))
    if k == 0 or sims[k] - sims[0] < margin:
        return "identity", b
    turned = type(b)(orient(b.rgb, ORIENTATIONS[k]), b.work_size)
    plain, turn = (max(find_template(a.scene, x.scene)[0], find_template(x.scene, a.scene)[0]) for x in (b, turned))
    return ("identity", b) if plain - turn >= margin else (ORIENTATIONS[k], turned)
