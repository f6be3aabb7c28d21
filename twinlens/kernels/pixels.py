"""Pixel arrays: gray, resampling, orientation, PNG, fingerprints and descriptor."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from twinlens.config import EMBEDDING, HASH

LUMA = np.array([0.299, 0.587, 0.114], dtype=np.float32)


def gray(rgb: np.ndarray) -> np.ndarray:
    """Float32 luma, not rounded; a gray image stays."""
    return rgb.astype(np.float32) if rgb.ndim == 2 else rgb.astype(np.float32) @ LUMA


@lru_cache(maxsize=512)
def _lanczos(src: int, dst: int) -> np.ndarray:
    """dst x src weights of a windowed sinc of three lobes, widened when shrinking."""
    scale = src / dst
    wide = max(scale, 1.0)
    x = (np.arange(src)[None, :] + 0.5 - (np.arange(dst)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize_plane(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """One float plane."""
    return _lanczos(a.shape[0], height) @ a.astype(np.float64) @ _lanczos(a.shape[1], width).T


@lru_cache(maxsize=512)
def _lanczos_single(src: int, dst: int) -> np.ndarray:
    return _lanczos(src, dst).astype(np.float32)


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """uint8 image, rounded and clipped after each pass."""
    h, w = rgb.shape[:2]
    if (h, w) == (height, width):
        return rgb
    planes = np.ascontiguousarray(rgb.transpose(2, 0, 1), dtype=np.float32)
    across = planes.reshape(3 * h, w) @ _lanczos_single(w, width).T
    np.clip(np.rint(across, out=across), 0, 255, out=across)
    down = _lanczos_single(h, height) @ across.reshape(3, h, width)
    np.clip(np.rint(down, out=down), 0, 255, out=down)
    return np.ascontiguousarray(down.astype(np.uint8).transpose(1, 2, 0))


def fit(width: int, height: int, longest: int) -> tuple[int, int]:
    """Size within ``longest``, never enlarged; rounds half to even."""
    if width <= 0 or height <= 0:
        raise ValueError("size must be positive")
    top = max(width, height)
    if top <= longest:
        return width, height
    return max(1, round(width * longest / top)), max(1, round(height * longest / top))


def fitted(rgb: np.ndarray, longest: int) -> np.ndarray:
    return resize(rgb, *fit(rgb.shape[1], rgb.shape[0], longest))


def orient(rgb: np.ndarray, name: str) -> np.ndarray:
    """Mirrored left to right first if the name says so, then turned clockwise."""
    out = rgb[:, ::-1] if name.startswith("mirror") else rgb
    turn = name.rsplit("rot", 1)
    return np.ascontiguousarray(np.rot90(out, -int(turn[1]) // 90) if len(turn) == 2 else out)


ORIENTATIONS = ["identity", "rot90", "rot180", "rot270", "mirror-h", "mirror-h-rot90", "mirror-h-rot180", "mirror-h-rot270"]

# EXIF orientation 1..8 as turns that make the picture upright.
EXIF_TURN = {1: "identity", 2: "mirror-h", 3: "rot180", 4: "mirror-h-rot180", 5: "mirror-h-rot270", 6: "rot90", 7: "mirror-h-rot90", 8: "rot270"}


def exif_orientation(data: bytes) -> int:
    """Orientation tag (274) of a JPEG's EXIF block; 1 without one."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + size]
            order = {b"II": "<", b"MM": ">"}.get(t[:2])
            if not order or len(t) < 8:
                return 1
            ifd = struct.unpack(order + "I", t[4:8])[0]
            if ifd + 2 > len(t):
                return 1
            for i in range(struct.unpack(order + "H", t[ifd : ifd + 2])[0]):
                e = t[ifd + 2 + 12 * i : ifd + 14 + 12 * i]
                if len(e) == 12 and struct.unpack(order + "H", e[:2])[0] == 274:
                    v = struct.unpack(order + "H", e[8:10])[0]
                    return v if v in EXIF_TURN else 1
            return 1
        at += 2 + size
    return 1


# ---- PNG -------------------------------------------------------------------------------------------


def png_encode(rgb: np.ndarray, effort: int = 6) -> bytes:
    """8-bit RGB or gray."""
    a = np.ascontiguousarray(rgb, dtype=np.uint8)
    h, w = a.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), dtype=np.uint8), a.reshape(h, -1)), axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, effort)) + chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows as they were before filtering. A run of rows that look to the left and above is undone along its
    diagonals, all rows of the run at once, each a pixel behind the one above it."""
    h, w, planes = x.shape
    out = np.zeros((h + 1, w + 1, planes), dtype=np.int32)  # a border of zeros above and at the left
    y = 0
    while y < h:
        if kinds[y] not in (3, 4):
            row = x[y].astype(np.int32)
            if kinds[y] == 1:
                row = np.cumsum(row, axis=0)
            elif kinds[y] == 2:
                row = row + out[y, 1:]
            out[y + 1, 1:] = row & 255
            y += 1
            continue
        end = y
        while end < h and kinds[end] in (3, 4):
            end += 1
        paeth = (kinds[y:end] == 4)[:, None]
        n = end - y
        for d in range(n + w - 1):
            r = np.arange(max(0, d - w + 1), min(n, d + 1))
            i, j = y + r + 1, d - r + 1
            left, up, corner = out[i, j - 1], out[i - 1, j], out[i - 1, j - 1]
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            best = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            out[i, j] = (x[i - 1, j - 1] + np.where(paeth[r], best, (left + up) // 2)) & 255
        y = end
    return out[1:, 1:].astype(np.uint8)


def png_decode(data: bytes) -> np.ndarray:
    """RGB of an 8-bit PNG that isn't interlaced; transparency is dropped. Raises ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("unsupported image")
    at, body, palette, head = 8, [], None, None
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body.append(part)
            elif kind == b"IEND":
                break
            at += 12 + n
        w, h, depth, color, _, _, interlace = head
        planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 or interlace:
            raise ValueError("unsupported image")
        rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(h, 1 + w * planes)
    except (TypeError, KeyError, struct.error, zlib.error, ValueError) as e:
        raise ValueError("unsupported image") from e
    out = _unfilter(rows[:, 0], rows[:, 1:].reshape(h, w, planes))
    if color == 3:
        return palette[out[:, :, 0]]
    return out[:, :, :3].copy() if planes >= 3 else np.repeat(out[:, :, :1], 3, axis=2)


# ---- fingerprints ------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _dct(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _pack(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big", signed=True)


def color_histogram(small: np.ndarray) -> np.ndarray:
    """64 bins of the two high bits of each channel of an image at hash size, unit length."""
    s = small.astype(np.int64) >> 6
    counts = np.bincount((s[:, :, 0] * 16 + s[:, :, 1] * 4 + s[:, :, 2]).ravel(), minlength=64).astype(np.float32)
    n = float(np.linalg.norm(counts))
    return counts / n if n else counts


def hash_size(rgb: np.ndarray) -> np.ndarray:
    return resize(rgb, HASH.work_size, HASH.work_size)


def hashes(small: np.ndarray) -> dict[str, int]:
    """The four hashes, as signed 64-bit integers, of an image at hash size."""
    work = gray(small)
    a = resize_plane(work, 8, 8)
    d = resize_plane(work, 9, 8)
    c = _dct(HASH.work_size)
    low = (c @ work.astype(np.float64) @ c.T)[:8, :8]
    wave = work.astype(np.float64)
    while wave.shape[0] > 8:
        wave = (wave[::2, ::2] + wave[1::2, ::2] + wave[::2, 1::2] + wave[1::2, 1::2]) / 4
    return {
        "ahash": _pack(a >= a.mean()),
        "dhash": _pack(d[:, 1:] > d[:, :-1]),
        "phash": _pack(low > np.median(low.ravel()[1:])),
        "whash": _pack(wave > np.median(wave)),
    }


def fingerprint(rgb: np.ndarray) -> dict:
    """The four hashes, the colour histogram, and luma statistics of the whole image."""
    small, full = hash_size(rgb), gray(rgb)
    return hashes(small) | {"color_hist": color_histogram(small), "luma_mean": float(full.mean()), "luma_std": float(full.std())}


def hash_similarity(a: dict, b: dict, weights: dict[str, float] = HASH.weights) -> float:
    return sum(w * (1 - ((int(a[k]) ^ int(b[k])) & (2**64 - 1)).bit_count() / 64) for k, w in weights.items()) / sum(weights.values())


def vector_cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a)) * float(np.linalg.norm(b))
    return float(np.clip(float(a.astype(np.float64) @ b.astype(np.float64)) / n, 0, 1)) if n else 0.0


def descriptor(rgb: np.ndarray, size: int = 128) -> np.ndarray:
    """368 numbers of unit length: colour moments and gradient directions of a 4 x 4 grid, the colour
    histogram, and the density of edges."""
    small = resize(rgb, size, size).astype(np.float64)
    g, bins = EMBEDDING.grid, EMBEDDING.hog_bins
    cells = small.reshape(g, size // g, g, size // g, 3).transpose(0, 2, 4, 1, 3).reshape(g * g, 3, -1)
    mean, std = cells.mean(axis=2), cells.std(axis=2)
    third = np.cbrt(((cells - mean[:, :, None]) ** 3).mean(axis=2))
    moments = np.stack((mean / 255, std / 255, 0.25 * third / (std + 1e-6)), axis=2)
    dy, dx = np.gradient(gray(small).astype(np.float64))
    mag, turn = np.hypot(dx, dy), (np.arctan2(dy, dx) + np.pi) / (2 * np.pi)
    cell = (np.arange(size) // (size // g))[:, None] * g + np.arange(size) // (size // g)
    direction = np.clip((turn * bins).astype(int), 0, bins - 1)
    hog = np.bincount((cell * bins + direction).ravel(), weights=mag.ravel(), minlength=g * g * bins).reshape(-1, bins)
    hog /= hog.sum(axis=1, keepdims=True) + 1e-6
    edges = np.bincount(cell.ravel(), weights=(mag > 24).ravel()) / (size // g) ** 2
    v = np.concatenate((moments.ravel(), hog.ravel(), color_histogram(hash_size(rgb)), edges))
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)
