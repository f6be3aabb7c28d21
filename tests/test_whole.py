import hashlib

from tests.conftest import rows


def _query(name):
    import __spark_entry__ as e

    return e.queries()[name]


def test_payloads_are_whole_texts(spark, tmp_path):
    same = "ä" * 2000
    texts = [same + "one", same + "two", "x" * 30_000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    data = [t if t is None else t.encode() for t in texts]
    want = [(i, None, None, "no data") if b is None else (i, len(b), hashlib.sha256(b).hexdigest(), None if b else "empty file") for i, b in enumerate(data)]
    assert rows(_query("inline_payloads")(spark, str(tmp_path))) == want


def test_pairs_of_every_one_to_one_label(spark, tmp_path):
    ones = {"EXACT_1TO1": True, "EDITED_1TO1": True, "NEAR_1TO1": True, "CROP": False}
    spark.createDataFrame(list(ones.items()), "label string, is_one_to_one boolean").write.parquet(str(tmp_path / "label_groups.parquet"))
    cards = [(lab, cid, c) for lab in ones for cid, c in (("a", 0.1), ("b", 0.6), ("c", 99.5), ("d", 100.0), ("d", 99.9), ("", 99.9), (None, 99.9), ("e", None))]
    cards.append(("NEAR_1TO1", "d", 99.9))
    spark.createDataFrame(cards, "label string, representative_cid string, confidence double").write.parquet(str(tmp_path / "cards.parquet"))
    want = sorted((lab, a, b, n) for lab in ones if ones[lab] for a, b, n in (("a", "b", 1), ("c", "d", 2)))
    assert rows(_query("pairs_within_label")(spark, str(tmp_path))) == want


def test_few_agreeing_matches_are_found():
    import numpy as np

    from twinlens.kernels import geometry as G

    found = 0
    for seed in range(40):
        r = np.random.default_rng(seed)
        a, b = r.uniform(0, 1, (400, 2)) * [640, 480], r.uniform(0, 1, (400, 2)) * [640, 480]
        some = r.permutation(400)[:15]
        b[some] = a[some] * 0.8 + [30, 20]
        words = r.integers(0, 2**64, (400, 4), dtype=np.uint64)
        m = G.match_features((a, words), (b, words), (640, 480), (640, 480))
        found += bool(m["trusted"] and abs(m["transform"][0, 0] - 0.8) < 0.02)
    assert found >= 39


def test_samples_and_the_projective_fallback():
    import numpy as np

    from twinlens.kernels import geometry as G

    assert all(len(set(x)) == 4 for x in G._samples(5, 4, 500).tolist()) and G._samples(5, 4, 500).max() == 4
    r = np.random.default_rng(1)
    a = r.uniform(0, 1, (60, 2)) * [640, 480]
    h = np.array([[0.9, 0.1, 12], [-0.05, 1.1, 7], [3e-4, 2e-4, 1]])
    x = np.c_[a, np.ones(60)] @ h.T
    b = x[:, :2] / x[:, 2:]
    b[:20] = r.uniform(0, 1, (20, 2)) * [640, 480]
    m, n = G.agreed_homography(a, b, 4.0)
    assert n >= 40 and np.allclose(m / m[2, 2], h, atol=0.05, rtol=0.05)
    assert G.agreed_similarity(np.ones((9, 2)), a[:9], 4.0) == (None, 0)
