from datetime import datetime

import numpy as np

from tests.conftest import rows
from twinlens.llm import survivor as S

CAND = "cid string, engine string, error string, url string, width int, height int, fetched_at timestamp, page_url string, engine_label string, usable int, members int"
CARD = "card_key string, member_cids array<string>, url string"


def _cand(cid, w=10, h=10, at=None, url="u", engine="e1", error=None, page=None, label=None):
    return (cid, engine, error, url and f"{url}-{cid}", w, h, at, page, label, 1, 1)


def test_order_of_preference(spark):
    t1, t2 = datetime(2023, 1, 1), datetime(2023, 2, 1)
    cands = [
        _cand("a", 10, 10, t1),
        _cand("b", 20, 5, t2),
        _cand("c", 20, 5, t2),
        _cand("d", 100, 100, t2, error="gone"),
        _cand("e", 30, 30, None, url=""),
        _cand("f", 30, 30, t1, url=None),
        _cand("g", 0, 9),
        _cand("h", None, 9),
        _cand("i", 5, 5, error=""),
    ]
    cards = [
        ("k1", ["a", "b", "c", "d"], "x"),
        ("k1", ["d", "c", "b", "a"], "x"),
        ("k2", ["a", "e", "f"], "x"),
        ("k3", ["e", "f"], "x"),
        ("k4", ["a", "a"], "x"),
        ("k5", ["g", "h", "i"], "x"),
        ("k6", ["a", "missing", None], "x"),
        ("k7", None, "x"),
        (None, ["a", "b"], "x"),
    ]
    got = S.surviving_records(spark.createDataFrame(cards, CARD), spark.createDataFrame(cands, CAND))
    assert rows(got, "card_key", "representative_cid", "url_cid", "best_width") == [("k1", "b", "b", 20), ("k2", "f", "a", 30), ("k3", "f", "", 30), ("k6", "a", "a", 10)]
    empty = S.surviving_records(spark.createDataFrame([], CARD), spark.createDataFrame([], CAND))
    assert rows(empty) == []


def _patterns(spark, data):
    return spark.createDataFrame(data, "field string, knows array<string>, states array<string>, n bigint")


def em(patterns, rounds):
    """The same model, value by value, in numpy."""
    names = sorted({s for k, _, _ in patterns for s in k})
    k = np.array([[s in p[0] for s in names] for p in patterns], dtype=float)
    s = np.array([[x in p[1] for x in names] for p in patterns], dtype=float)
    n = np.array([p[2] for p in patterns], dtype=float)
    sens, fp, truth = np.full(len(names), 0.6), np.full(len(names), 0.1), 0.5
    for _ in range(rounds):
        t = truth * (sens**s * (1 - sens) ** (k - s)).prod(axis=1)
        f = (1 - truth) * (fp**s * (1 - fp) ** (k - s)).prod(axis=1)
        p = t / (t + f)
        a, b = n * p, n * (1 - p)
        sens, fp = (a @ s + 5) / (a @ k + 10), (b @ s + 1) / (b @ k + 20)
        truth = (a.sum() + 5) / (n.sum() + 10)
    return dict(zip(names, sens)), dict(zip(names, fp)), truth


def test_model_recovers_two_sided_quality(spark):
    r = np.random.default_rng(1)
    n, sens, fp = 4000, np.array([0.9, 0.6, 0.8, 0.5]), np.array([0.05, 0.02, 0.4, 0.01])
    truth = r.random(n) < 0.5
    said = np.where(truth[:, None], r.random((n, 4)) < sens, r.random((n, 4)) < fp)
    states = (said * (1 << np.arange(4))).sum(axis=1)
    seen = states > 0
    pat, count = np.unique(states[seen], return_counts=True)
    name = lambda m: [f"e{i}" for i in range(4) if m >> i & 1]
    df = _patterns(spark, [("f", name(15), name(int(m)), int(c)) for m, c in zip(pat, count)])
    q = S.fit_quality(df, 40)
    p = {tuple(r["states"]): r["p"] for r in df.withColumn("p", q.probability(df["field"], df["knows"], df["states"])).collect()}
    right = np.array([p[tuple(name(int(m)))] >= 0.5 for m in states[seen]]) == truth[seen]
    assert right.mean() > 0.85
    f = [q.false_positive["f", f"e{i}"] for i in range(4)]
    assert f[2] > 2 * max(f[0], f[1], f[3])
    a, b, c = em([(name(15), name(int(m)), int(k)) for m, k in zip(pat, count)], 40)
    assert all(abs(q.sensitivity["f", e] - a[e]) < 1e-9 and abs(q.false_positive["f", e] - b[e]) < 1e-9 for e in a) and abs(q.truth["f"] - c) < 1e-9


def test_twelve_sources_each_for_itself(spark):
    r = np.random.default_rng(5)
    names = [f"e{i:02d}" for i in range(12)]
    pats = []
    for _ in range(300):
        k = [e for e in names if r.random() < 0.7]
        pats.append((k, [e for e in k if r.random() < 0.5], int(r.integers(1, 9))))
    q = S.fit_quality(_patterns(spark, [("f", *p) for p in pats]), 6)
    a, b, c = em(pats, 6)
    assert len(a) == 12 and all(abs(q.sensitivity["f", e] - a[e]) < 1e-9 and abs(q.false_positive["f", e] - b[e]) < 1e-9 for e in names)


def test_every_true_value_is_kept(spark):
    cands, cards = [], []
    for g in range(60):
        for e in ("e1", "e2", "e3"):
            cands.append(_cand(f"{g:02d}{e}a", engine=e, page="p1"))
            cands.append(_cand(f"{g:02d}{e}b", engine=e, page="p2"))
        cands.append(_cand(f"{g:02d}z", engine="liar", page=f"junk{g}"))
        cards.append((f"k{g:02d}", [c[0] for c in cands if c[0].startswith(f"{g:02d}")], "x"))
    book = S.Survivors(spark.createDataFrame(cards, CARD), spark.createDataFrame(cands, CAND))
    got = rows(book.true_values().where("field = 'page_url'"), "card_key", "value")
    assert got == sorted((f"k{g:02d}", p) for g in range(60) for p in ("p1", "p2"))
    sens = book.quality.sensitivity
    assert sens["page_url", "liar"] < 0.3 < sens["page_url", "e1"]
    assert rows(book.records(), "pages", "first_page") == [(2, "p1")] * 60


def test_survivors_come_from_the_members_judged_true(spark, monkeypatch):
    cands = [_cand(c) for c in "abcd"] + [_cand("e", 0, 0, error="gone"), _cand("f", None, None, error="gone")]
    cards = spark.createDataFrame([("k", list("abef"), "x"), ("l", list("cd"), "x")], CARD)
    df = spark.createDataFrame(cands, CAND)
    assert rows(S.surviving_records(cards, df), "card_key", "representative_cid") == [("k", "a"), ("l", "c")]
    # without the model no member is judged, and no group survives
    monkeypatch.setattr(S, "fit_quality", lambda *a: S.Quality())
    assert rows(S.surviving_records(cards, df)) == []


def test_most_records_failed(spark):
    cands = [_cand(f"x{i:03d}", 0, None, error="gone") for i in range(200)] + [_cand(f"y{i:03d}", 9, 9, error="late") for i in range(200)] + [_cand("a"), _cand("b")]
    cards = spark.createDataFrame([("k", [c[0] for c in cands], "x")], CARD)
    assert rows(S.surviving_records(cards, spark.createDataFrame(cands, CAND)), "representative_cid", "members") == [("a", 402)]
