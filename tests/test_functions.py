import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlens.functions import geometry as G
from twinlens.functions import hashes as H
from twinlens.functions import signals as S
from twinlens.functions import urls as U
from twinlens.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_canonical_url(spark):
    same = ["https://A.com/x/?utm_source=1", "https://a.com/x#f", " HTTPS://a.COM/x/ ", "https://a.com/x"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(U.canonical_url(F.col("u"))).collect()}
    assert got == {"https://a.com/x"}
    assert one(spark, U.canonical_url(F.lit("https://a.com")))[0] == "https://a.com/"
    assert one(spark, U.canonical_url(F.lit(None).cast("string")))[0] is None


def test_routes_and_containment(spark):
    r = one(spark, U.fetch_route(F.lit("data:image/png;base64,AA")), U.fetch_route(F.lit("/corpus/a.png")), U.fetch_route(F.lit("HTTP://x")), U.fetch_route(F.lit("ftp://x")))
    assert tuple(r) == ("data", "corpus", "http", "unsupported")
    r = one(spark, U.inside(F.lit("/corpus2/a"), F.lit("/corpus")), U.inside(F.lit("/corpus/a"), F.lit("/corpus")), U.inside(F.lit("/corpus/../a"), F.lit("/corpus")))
    assert tuple(r) == (False, True, False)
    r = one(spark, U.file_suffix(F.lit("A.JPEG")), U.file_suffix(F.lit("a.txt")), U.content_type_allowed(F.lit("text/html")), U.content_type_allowed(F.lit(None).cast("string")))
    assert tuple(r) == (".jpeg", "", False, True)


def test_hash_round_trip_and_similarity(spark):
    for h in ("0000000000000000", "ffffffffffffffff", "8000000000000001"):
        assert one(spark, H.to_hex(H.from_hex(F.lit(h))))[0] == h
    a, b = H.from_hex(F.lit("ffffffffffffffff")), H.from_hex(F.lit("fffffffffffffff0"))
    assert tuple(one(spark, H.hamming(a, b), H.similarity(a, b), H.similarity(a, a))) == (4, 0.9375, 1.0)
    assert one(spark, H.from_hex(F.lit("xyz")))[0] is None
    assert one(spark, H.to_hex(H.from_bits(F.lit("1" + "0" * 63))))[0] == "8" + "0" * 15


@pytest.mark.parametrize("w,h,want", [(1920, 1080, (512, 288)), (1080, 1920, (288, 512)), (300, 200, (300, 200)), (5000, 1, (512, 1))])
def test_fit_size(spark, w, h, want):
    assert tuple(one(spark, *G.fit_size(F.lit(float(w)), F.lit(float(h)), 512))) == want


def test_coverage_boxes(spark):
    box = [F.lit(float(v)) for v in (160, 120, 480, 360, 640, 480)]
    o, c = G.coverage_of_crop(*box)
    assert tuple(one(spark, o, c)) == (0.25, 1.0)
    framed = [F.lit(float(v)) for v in (50, 50, 690, 530, 740, 580)]
    o, c = one(spark, *G.coverage_of_box(*framed))
    assert o == 1.0 and c < 0.9
    assert one(spark, G.aspect_similarity(F.lit(0.0), F.lit(1.0)))[0] == 0


def test_vectors(spark):
    a, b, z = (F.array(*(F.lit(float(x)) for x in v)) for v in ((1, 0), (1, 1), (0, 0)))
    r = one(spark, V.cosine(a, b), V.cosine(a, z), V.cosine(a, F.array(F.lit(1.0))), V.l2_normalise(b)[0], V.l2_normalise(z)[0])
    assert r[0] == pytest.approx(0.70710678) and r[1] == 0 and r[2] == 0 and r[3] == pytest.approx(0.70710678) and r[4] == 0
    sim, name = V.embedding_similarity(a, b, F.lit("x"), F.lit("y"))
    assert tuple(one(spark, sim, name)) == (0.0, "mismatch(x/y)")


def test_confidence_is_monotone_and_bounded(spark):
    got = [r[0] for r in spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "m double").select(S.confidence(F.col("m"))).collect()]
    assert got == sorted(got) and 0 < got[0] and got[-1] < 100
