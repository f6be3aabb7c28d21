"""A synthetic result set for an image: copies, edits, crops, a lookalike and unrelated images."""

from __future__ import annotations

import numpy as np

from twinlens.kernels.jpeg import jpeg_encode
from twinlens.kernels.pixels import orient, png_encode, resize


def scene(seed: int = 42, width: int = 640, height: int = 480, shapes: int = 70) -> np.ndarray:
    """A structured picture: smooth waves under blended discs and boxes."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    phase = r.random(3) * 6
    img = np.stack((120 + 60 * np.sin(x / 97 + phase[0]) + 30 * np.cos(y / 61), 110 + 70 * np.cos((x + y) / 120 + phase[1]), 130 + 50 * np.sin(y / 80 + phase[2])), axis=-1)
    for _ in range(shapes):
        cx, cy, rx, ry = r.integers(0, width), r.integers(0, height), r.integers(8, 60), r.integers(8, 60)
        inside = ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 < 1 if r.random() < 0.5 else (abs(x - cx) < rx) & (abs(y - cy) < ry)
        img[inside] = img[inside] * 0.3 + r.integers(0, 255, 3) * 0.7
    return _bytes(img)


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def _soften(a: np.ndarray, radius: float) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-6, 7) / radius) ** 2)
    k /= k.sum()
    p = np.pad(a.astype(float), ((6, 6), (6, 6), (0, 0)), mode="edge")
    p = sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))
    return _bytes(sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k)))


def _marked(a: np.ndarray) -> np.ndarray:
    """A box outline and strokes in a corner."""
    out = a.copy()
    h, w = a.shape[:2]
    x0, y0, x1, y1 = int(w * 0.80), int(h * 0.90), int(w * 0.97), int(h * 0.96)
    for s in (slice(y0, y0 + 2), slice(y1 - 2, y1)):
        out[s, x0:x1] = 255
    for s in (slice(x0, x0 + 2), slice(x1 - 2, x1)):
        out[y0:y1, s] = 255
    for i in range(x0 + 8, x1 - 8, 12):
        out[y0 + 8 : y1 - 8, i : i + 2] = 250
    return out


def lookalike(a: np.ndarray, seed: int = 7) -> np.ndarray:
    """Another photograph of the same subject: a zoom, a slant and new fine detail everywhere."""
    r = np.random.default_rng(seed)
    h, w = a.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u = np.clip((x - w / 2) / 1.05 + w / 2 + (y - h / 2) * 0.03 + 3 * np.sin(y / 23), 0, w - 1).astype(int)
    v = np.clip((y - h / 2) / 1.05 + h / 2 + (x - w / 2) * 0.02 + 3 * np.sin(x / 29), 0, h - 1).astype(int)
    grain = resize(_bytes(128 + r.normal(0, 60, (h // 4, w // 4, 3))), w, h).astype(float) - 128
    return _bytes(a[v, u] + grain * 0.25 + r.normal(0, 7, a.shape))


def unrelated(seed: int, width: int = 640, height: int = 480) -> np.ndarray:
    """Rings on a dark ground."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    out = np.full((height, width, 3), 18.0) + r.normal(0, 3, (height, width, 3))
    for _ in range(12):
        d = np.hypot(x - r.integers(0, width), y - r.integers(0, height))
        size = r.integers(20, 140)
        out[np.abs(d - size) < r.integers(2, 9)] = r.integers(60, 255, 3)
    return _bytes(out)


def variants(a: np.ndarray) -> dict[str, tuple[np.ndarray, str]]:
    """Named edits of an image with the label each deserves."""
    h, w = a.shape[:2]
    f = a.astype(float)
    pad = int(min(h, w) * 0.06)
    bars = int(h * 0.09)
    framed = np.pad(a, ((pad, pad), (pad, pad), (0, 0)), constant_values=248)
    shot = np.pad(a, ((bars, bars), (0, 0), (0, 0)), constant_values=32)
    return {
        "identical": (a, "EXACT_1TO1"),
        "resized_half": (resize(a, w // 2, h // 2), "EXACT_1TO1"),
        "resized_double": (resize(a, w * 2, h * 2), "EXACT_1TO1"),
        "brightness_up": (_bytes(f + 26), "EDITED_1TO1"),
        "brightness_down": (_bytes(f - 26), "EDITED_1TO1"),
        "contrast_up": (_bytes((f - f.mean()) * 1.28 + f.mean()), "EDITED_1TO1"),
        "colour_shift": (_bytes(f + [30, -18, 12]), "EDITED_1TO1"),
        "watermarked": (_marked(a), "EDITED_1TO1"),
        "bordered": (framed, "EDITED_1TO1"),
        "screenshot": (resize(shot, round(w * 0.85), round(shot.shape[0] * 0.85)), "EDITED_1TO1"),
        "blurred": (_soften(a, 1.6), "EDITED_1TO1"),
        "rotated_90": (orient(a, "rot90"), "EDITED_1TO1"),
        "rotated_180": (orient(a, "rot180"), "EDITED_1TO1"),
        "mirrored": (orient(a, "mirror-h"), "EDITED_1TO1"),
        "crop_centre": (a[h // 4 : h * 3 // 4, w // 4 : w * 3 // 4], "CROP"),
        "crop_corner": (a[: int(h * 0.66), : int(w * 0.62)], "CROP"),
        "crop_wide": (a[h // 10 : h * 9 // 10, w // 10 : w * 9 // 10], "CROP"),
        "lookalike": (lookalike(a), "VISUALLY_SIMILAR"),
        "unrelated": (unrelated(777, w, h), "UNRELATED"),
    }


def other_photo(a: np.ndarray, seed: int = 11) -> np.ndarray:
    """The same subject shot again: a zoom of four hundredths, a change of perspective, and new fine detail."""
    r = np.random.default_rng(seed)
    h, w = a.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    depth = 1 + 0.05 * (x / w - 0.5) + 0.03 * (y / h - 0.5)
    u = np.clip(((x - w / 2) / 1.04) / depth + w / 2, 0, w - 1).astype(int)
    v = np.clip(((y - h / 2) / 1.04) / depth + h / 2, 0, h - 1).astype(int)
    grain = resize(_bytes(128 + r.normal(0, 60, (h // 3, w // 3, 3))), w, h).astype(float) - 128
    return _bytes(a[v, u] + grain * 0.3 + r.normal(0, 6, a.shape))


def cases(a: np.ndarray) -> list[tuple[str, bytes, str]]:
    """(name, file, label it deserves) of the labelled matrix: the same picture in other files, edits, turns, crops and
    what must not be taken for it. Edits are JPEG files as a camera or a site would make them, turns are PNG."""
    exact, edited = "EXACT_1TO1", "EDITED_1TO1"
    made = variants(a)
    h, w = a.shape[:2]
    png = png_encode(a)
    r = np.random.default_rng(3)
    out = [
        ("identical_bytes", png, exact),
        ("renamed_identical", png, exact),
        ("metadata_stripped", jpeg_encode(a, 90), exact),
        ("metadata_added", jpeg_encode(np.ascontiguousarray(np.rot90(a)), 95, 6), exact),
        ("resized_down_half", png_encode(resize(a, w // 2, h // 2)), exact),
        ("resized_up_double", jpeg_encode(resize(a, w * 2, h * 2), 92), exact),
        ("jpeg_recompressed", jpeg_encode(a, 82), exact),
        ("png_to_jpeg", jpeg_encode(a, 88), exact),
        ("heavily_compressed", jpeg_encode(a, 18), exact),
    ]
    for name in ("brightness_up", "brightness_down", "contrast_up", "colour_shift", "watermarked", "bordered", "blurred"):
        out.append((name, jpeg_encode(made[name][0], 90), edited))
    for name in ("screenshot", "rotated_90", "rotated_180", "mirrored"):
        out.append((name, png_encode(made[name][0]), edited))
    for name in ("crop_centre", "crop_corner", "crop_wide"):
        out.append((name, jpeg_encode(made[name][0], 90), "CROP"))
    grainy = _bytes(_soften(a, 1.8) + r.normal(0, 14, a.shape))
    return out + [
        ("grainy", png_encode(grainy), "NEAR_1TO1"),
        ("different_photo_same_subject", jpeg_encode(other_photo(a), 90), "VISUALLY_SIMILAR"),
        ("lookalike", jpeg_encode(made["lookalike"][0], 90), "VISUALLY_SIMILAR"),
        ("unrelated_image", jpeg_encode(made["unrelated"][0], 90), "UNRELATED"),
        ("broken_file", png[: len(png) // 2], "ERROR"),
    ]


def result_set(a: np.ndarray, include_unrelated: int = 3) -> list[dict]:
    """Hits with their bytes: the variants, one address given twice, the same bytes at another address,
    a lookalike and unrelated images."""
    engines = ["alpha", "beta", "gamma"]
    out: list[dict] = []

    def add(name: str, img: np.ndarray, url: str | None = None, label: str = "Similar") -> None:
        i = len(out)
        out.append(
            {
                "seq": i + 1,
                "url": url or f"https://images.example/{name}.png",
                "engine": engines[i % 3],
                "engine_label": label,
                "page_url": f"https://pages.example/{engines[i % 3]}/{name}",
                "title": name,
                "data": png_encode(img),
            }
        )

    made = variants(a)
    for name, (img, expected) in made.items():
        if expected not in ("VISUALLY_SIMILAR", "UNRELATED") and len(out) < 17:
            add(name, img)
    add("identical_again", a, url="https://images.example/identical.png?again=1")
    add("identical_elsewhere", a)
    add("lookalike", made["lookalike"][0], label="Exact match")
    for i in range(include_unrelated):
        add(f"unrelated_{i}", unrelated(100 + i))
    return out
