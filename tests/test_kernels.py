import struct
import zlib

import numpy as np
import pytest

from twinlens.kernels import compare as C
from twinlens.kernels import geometry as G
from twinlens.kernels import pair as P
from twinlens.kernels import pixels as X
from twinlens.sources import demo

A = demo.scene(width=320, height=240, shapes=60)


def test_png_round_trip_and_filters():
    assert (X.png_decode(X.png_encode(A)) == A).all()
    g = A[:20, :30, 0]
    assert (X.png_decode(X.png_encode(g))[:, :, 1] == g).all()
    h, w = 6, 5
    img = A[:h, :w].astype(int)
    raw = b""
    for y in range(h):
        kind = y % 5
        line = []
        for x in range(w):
            for c in range(3):
                a = img[y, x - 1, c] if x else 0
                b = img[y - 1, x, c] if y else 0
                d = img[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
                line.append((img[y, x, c] - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        raw += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (X.png_decode(data) == img).all()
    for bad in (b"", b"nonsense", data[:40]):
        with pytest.raises(ValueError):
            X.png_decode(bad)


def test_orientations_invert():
    for name, back in [("rot90", "rot270"), ("rot180", "rot180"), ("mirror-h", "mirror-h"), ("mirror-h-rot90", "mirror-h-rot90")]:
        assert (X.orient(X.orient(A, name), back) == A).all()
    assert X.orient(A, "rot90").shape == (320, 240, 3)


def test_exif_orientation():
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 274, 3, 1, 6, 0) + struct.pack("<I", 0)
    body = b"Exif\0\0" + tiff
    assert X.exif_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda") == 6
    assert X.exif_orientation(b"\xff\xd8\xff\xda") == 1 and X.exif_orientation(b"png") == 1


def test_fingerprints():
    a, half = X.fingerprint(A), X.fingerprint(X.resize(A, 128, 96))
    assert X.hash_similarity(a, a) == 1 and X.hash_similarity(a, half) >= 0.9
    assert X.hash_similarity(a, X.fingerprint(demo.unrelated(5, 320, 240))) < 0.78
    assert X.gray(np.full((1, 1, 3), (255, 0, 0), dtype=np.uint8))[0, 0] == pytest.approx(76.245, abs=0.01)
    d = X.descriptor(A)
    assert d.shape == (368,) and np.linalg.norm(d) == pytest.approx(1, abs=1e-5)


def test_polygons_and_transforms():
    sq = np.array([[0, 0], [4, 0], [4, 2], [0, 2]], dtype=float)
    assert G.polygon_area(sq) == 8 and G.polygon_area(G.clip_polygon(sq, 2, 10)) == 4
    size = (320, 240)
    assert G.coverage_of_transform(np.eye(3), size, size)["original"] == pytest.approx(1)
    c = G.coverage_of_transform(np.diag([2, 2, 1.0]), size, (640, 480))
    assert (c["original"], c["candidate"], c["scale"]) == (pytest.approx(1), pytest.approx(1), pytest.approx(2))
    assert G.coverage_of_transform(np.eye(3), size, (160, 120))["original"] == pytest.approx(0.25)
    assert G.coverage_of_transform(np.zeros((3, 3)), size, size) is None


def test_measures_on_equal_images():
    assert C.ssim(A, A) == pytest.approx(1) and C.ms_ssim(A, A) == pytest.approx(1)
    assert C.nrmse_similarity(A, A) == 1 and C.psnr(A, A) == 100 and C.gradient_correlation(A, A) == pytest.approx(1)
    e = C.measure_edits(A, A)
    assert e["changed"] == 0 and C.edit_names(C.edit_flags(e, False)) == []
    gain, offset, r2 = C.linear_fit(np.array([1.0, 2, 3] * 10), np.array([3.0, 5, 7] * 10))
    # the gain is the sample covariance over the population variance, a little off the line that fits best
    assert gain == pytest.approx(2 * 30 / 29) and r2 == pytest.approx(1 - (1 / 29) ** 2)
    assert C.linear_fit(np.arange(20.0), np.full(20, 7.0)) == (0.0, 7.0, 1.0)
    assert C.linear_fit(np.full(20, 3.0), np.arange(20.0)) == (1.0, 6.5, 0.0)


@pytest.mark.parametrize("share,found", [(0.06, True), (0.03, True), (0, False)])
def test_border(share, found):
    p = int(240 * share)
    framed = np.pad(A, ((p, p), (p, p), (0, 0)), constant_values=248) if p else A
    assert C.find_border(framed, 320 / 240)[0] == found
    assert C.find_border(X.resize(A, 256, 192), 320 / 240) == (False, 0.0)


def test_edits_are_named():
    f = A.astype(float)
    names = lambda b: C.edit_names(C.edit_flags(C.measure_edits(A, np.clip(b, 0, 255).astype(np.uint8)), False))
    assert "brightness" in names(f + 26)
    assert "contrast" in names((f - f.mean()) * 0.7 + f.mean())
    assert "colour" in names(f + [30, -18, 12])
    assert "blur" in names(demo._soften(A, 2.0))


def test_pair_geometry():
    crop = P.signals(A, A[60:180, 80:240])
    assert crop["coverage_orig"] == pytest.approx(0.25, abs=0.03) and crop["ssim"] > 0.9
    turned = P.signals(A, X.orient(A, "rot90"))
    assert turned["orientation"] == "rot270" and turned["ssim"] > 0.99
    other = P.signals(A, demo.unrelated(3, 320, 240))
    assert other["changed_fraction"] > 0.5 and not other["trusted"]
    q = P.quick_pair(P.summary(A), P.summary(A))
    assert q["identity"] == pytest.approx(1) and q["edit_labels"] == []
    r = P.render(A, A, 64)
    assert r["difference"].max() == 0 and r["heatmap"].shape == (64, 64, 3)


def test_a_border_is_sought_in_the_second_picture():
    bars = np.pad(A, ((22, 22), (0, 0), (0, 0)), constant_values=32)
    plain, framed = P.summary(A), P.summary(bars)
    assert "border" in P.quick_pair(plain, framed)["edit_labels"]
    assert "border" not in P.quick_pair(framed, plain)["edit_labels"]
    assert P.signals(A, bars)["border"] and not P.signals(bars, A)["border"]


def test_border_equals_a_search_by_thickness():
    for share in (0.02, 0.05, 0.1):
        p = int(240 * share)
        framed = np.pad(A, ((p, p), (p // 2, p // 2), (0, 0)), constant_values=90)
        g = X.gray(framed).astype(float)
        most = round(min(g.shape) * 0.12)
        flat = lambda s: s.std() <= 6.0
        bands = C.flat_bands(framed)
        assert bands["across"] == [t for t in range(2, most + 1) if flat(g[:t]) and flat(g[-t:])]
        assert bands["along"] == [t for t in range(2, most + 1) if flat(g[:, :t]) and flat(g[:, -t:])]


def test_windows_of_structure_equal_a_loop():
    r = np.random.default_rng(0)
    x, y = r.integers(0, 255, (2, 20, 24)).astype(float)
    got, total = C._ssim_gray(x, y), []
    for i in range(14):
        for j in range(18):
            p, q = x[i : i + 7, j : j + 7], y[i : i + 7, j : j + 7]
            cov = np.cov(p.ravel(), q.ravel())
            a, b = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            total.append((2 * p.mean() * q.mean() + a) * (2 * cov[0, 1] + b) / ((p.mean() ** 2 + q.mean() ** 2 + a) * (cov[0, 0] + cov[1, 1] + b)))
    assert got == pytest.approx(np.mean(total), abs=1e-12)


def test_hashes_of_turned_pictures_are_those_of_the_whole():
    small, aside = X.hash_size(A), X.hash_size(X.orient(A, "rot90"))
    for name in X.ORIENTATIONS:
        turned = P.Picture(X.orient(A, name))
        back = G.best_orientation(P.Picture(A), turned, 0.08)
        assert (back[1].rgb == A).all() or name == "identity"
    assert (small != aside).any()


def test_convex_polygons_against_sampling():
    r = np.random.default_rng(4)
    turn = np.sort(r.uniform(0, 2 * np.pi, (30, 6)), axis=1)
    p = np.stack((np.cos(turn), np.sin(turn)), axis=-1)
    turn = np.sort(r.uniform(0, 2 * np.pi, (30, 4)), axis=1)
    q = np.stack((np.cos(turn), np.sin(turn)), axis=-1) * r.uniform(0.4, 1.2, (30, 1, 1)) + r.uniform(-0.5, 0.5, (30, 1, 2))
    q[::2] = q[::2, ::-1]
    got, count = G.convex_intersections(p, q)
    area = np.abs(G.signed_areas(got, count))
    at = r.uniform(-1, 1, (40_000, 2))

    def inside(poly):
        poly = poly if G.signed_areas(poly[None])[0] > 0 else poly[::-1]
        a, b = poly, np.roll(poly, -1, axis=0)
        return (G._cross((b - a)[None], at[:, None] - a[None]) >= 0).all(axis=1)

    for i in range(30):
        assert area[i] == pytest.approx(4 * (inside(p[i]) & inside(q[i])).mean(), abs=0.03)
    far, n = G.convex_intersections(p[:1], q[:1] + 9)
    assert n[0] == 0 and G.signed_areas(far, n)[0] == 0
