import numpy as np
import pytest

from tests.conftest import rows
from twinlens.llm import minmax as M
from twinlens.llm import vptree as V

DDL = "cid string, ahash string, dhash string, phash string, whash string, band int, x string"


def _noisy(r, base, flips):
    out = list(base)
    for b in r.choice(256, flips, replace=False):
        out[b // 64] ^= 1 << int(b % 64)
    return out


def _candidates(seed=1, groups=40):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [int(x) for x in r.integers(0, 2**64, 4, dtype=np.uint64)]
        for k in range(6):
            v = _noisy(r, base, int(r.integers(0, 30)))
            out.append((f"c{len(out):04d}", *(f"{x:016x}" for x in v), 1, "y"))
    return out


def brute(data):
    val = [(c, [int(h, 16) for h in (p, d, w, a)]) for c, a, d, p, w, *_ in data]
    out = []
    for i, (c, x) in enumerate(val):
        for e, y in val[i + 1 :]:
            if sum(w * (m ^ n).bit_count() for w, m, n in zip(M.WEIGHTS, x, y)) <= M.MAX_DISTANCE:
                out.append((min(c, e), max(c, e)))
    return sorted(out)


def test_all_near_pairs(spark):
    data = _candidates()
    got = rows(M.near_candidates(spark.createDataFrame(data, DDL)))
    want = brute(data)
    assert len(want) > 50 and got == want


def test_large_bands_and_classes_in_cells(spark, monkeypatch):
    monkeypatch.setattr(M.salted_join, "__defaults__", ("inner", 10, 4, None))
    data = _candidates(7, 8)
    data += [(f"d{i:03d}", *data[3][1:]) for i in range(40)] + [(f"e{i:03d}", *data[4][1:]) for i in range(9)]
    want = brute(data)
    assert len(want) > 40 * 39 / 2
    assert rows(M.near_candidates(spark.createDataFrame(data, DDL), band_rows=3, member_rows=7)) == want


def test_no_broadcast_of_what_grows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for df in (M.near_candidates(spark.createDataFrame(_candidates(2, 5), DDL)), M.candidate_classes(spark.createDataFrame(_candidates(2, 5), DDL))):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan
            # only lists of hot keys, limited in number, may be broadcast
            assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [band") and "MapInArrow" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_signature_grows_with_the_collection():
    assert M.signature_shape(20_000) == (64, 10)
    (b1, v1), (b2, v2) = M.signature_shape(10**6), M.signature_shape(10**9)
    assert v1 < v2 and b1 < b2
    for bands, values in ((b1, v1), (b2, v2)):
        assert (1 - (0.9 / 1.1) ** values) ** bands <= M.MISS


def test_readings_and_defined_cases(spark):
    p = "00ff00ff00ff00ff"
    data = [
        ("a", p, p, p, p, 1, None),
        ("b", " 0X" + p.upper() + "\n", "0xff00ff00ff00ff", "00:ff:00:ff:00:ff:00:ff", p, 1, None),
        ("b", " 0X" + p.upper() + "\n", "0xff00ff00ff00ff", "00:ff:00:ff:00:ff:00:ff", p, 1, None),
        ("c", None, p, p, p, 1, None),
        ("d", "", p, p, p, 1, None),
        ("e", "n/a", p, p, p, 1, None),
        ("f", "nan", p, p, p, 1, None),
        ("g", "1" + p, p, p, p, 1, None),
        (None, p, p, p, p, 1, None),
    ]
    df = spark.createDataFrame(data, DDL)
    assert rows(M.near_candidates(df)) == [("a", "b")]
    assert rows(M.candidate_classes(df)) == [("a", 2, 0)]
    assert rows(M.near_candidates(spark.createDataFrame([], DDL))) == []


def test_signature_agrees_like_weighted_jaccard():
    r = np.random.default_rng(2)
    base = [int(x) for x in r.integers(0, 2**64, 4, dtype=np.uint64)]
    other = _noisy(r, base, 40)
    a, b = (M._spread_bits(np.array([v], dtype=np.uint64)) for v in (base, other))
    same = [M._first_present(o, a)[0] == M._first_present(o, b)[0] for order in M._orders(1500) for o in (order, order[::-1])]
    d = sum(w * (x ^ y).bit_count() for w, x, y in zip(M.WEIGHTS, base, other)) / 6400
    assert abs(np.mean(same) - (1 - d) / (1 + d)) < 0.03


def _vectors(seed=4, n=400, dim=368):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 1, (40, dim)) + 0.6
    v = centre[r.integers(0, 40, n)] + r.normal(0, 0.35, (n, dim))
    return v.astype(np.float32) * r.uniform(0.5, 3, (n, 1)).astype(np.float32)


def nearest(ids, v, k, least):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    out = set()
    for i in range(len(u)):
        c = np.round(u @ u[i], 6)
        best = sorted((-c[j], ids[j]) for j in range(len(u)) if j != i and c[j] >= least)[:k]
        out |= {tuple(sorted((ids[i], j))) for _, j in best}
    return sorted(out)


DESC = "vec_id bigint, backend string, vector array<float>, cell int, kind string"


def _table(spark, v, backend="classical-descriptor"):
    return spark.createDataFrame([(i + 1, backend, [float(y) for y in x], 0, "z") for i, x in enumerate(v)], DESC)


@pytest.mark.parametrize("shard,relax", [(10_000, 1.0), (64, 1.0), (64, V.RELAX)])
def test_neighbours_against_brute_force(spark, shard, relax):
    v = _vectors()
    got = rows(V.neighbour_pairs(_table(spark, v), shard_rows=shard, relax=relax, leaf_rows=16))
    want = nearest(list(range(1, len(v) + 1)), v, 10, 0.8)
    if relax == 1:
        assert got == want
    assert len(set(got) & set(want)) >= 0.99 * len(want)


def test_vector_defined_cases(spark):
    e = [1.0] + [0.0] * 367
    nan, inf = [float("nan")] + [0.0] * 367, [float("inf")] + [0.0] * 367
    data = [
        (1, "classical-descriptor", e, 0, "z"),
        (2, "classical-descriptor", [2.0 * x for x in e], 0, "z"),
        (2, "classical-descriptor", [2.0 * x for x in e], 0, "z"),
        (3, "classical-descriptor", None, 0, "z"),
        (4, "classical-descriptor", [], 0, "z"),
        (5, "classical-descriptor", [0.0] * 368, 0, "z"),
        (6, "classical-descriptor", nan, 0, "z"),
        (7, "classical-descriptor", inf, 0, "z"),
        (8, "classical-descriptor", e[:360], 0, "z"),
        (9, "clip:ViT-B-32", [1.0] * 512, 0, "z"),
        (10, "clip:ViT-B-32", [1.0] * 368, 0, "z"),
        (11, None, e, 0, "z"),
        (None, "classical-descriptor", e, 0, "z"),
        (12, "classical-descriptor", [None] + [1.0] * 367, 0, "z"),
    ]
    assert rows(V.neighbour_pairs(spark.createDataFrame(data, DESC))) == [(1, 2)]
    assert rows(V.neighbour_pairs(spark.createDataFrame([], DESC))) == []


def test_ties_go_to_the_lesser_id(spark):
    v = np.tile(np.eye(1, 368, dtype=np.float32), (14, 1))
    got = V.nearest_neighbours(_table(spark, v))
    assert sorted(r["neighbour"] for r in got.where("id = 14").collect()) == list(range(1, 11))


def test_many_equal_vectors_and_several_vectors_of_one_id(spark):
    v = _vectors(9, 120)
    v = np.concatenate((v, np.tile(v[:1], (200, 1))))
    df = _table(spark, v)
    got = rows(V.neighbour_pairs(df, shard_rows=40, relax=1.0, leaf_rows=8))
    assert got == nearest(list(range(1, len(v) + 1)), v, 10, 0.8)
    # the same where all but the least ids of much copied vectors stand aside
    few = rows(V.neighbour_pairs(df, shard_rows=40, relax=1.0, leaf_rows=8, many_copies=20))
    assert few == got
    assert rows(V.nearest_neighbours(df, relax=1.0, many_copies=20)) == rows(V.nearest_neighbours(df, relax=1.0))
    again = df.unionAll(spark.range(300).join(df.where("vec_id = 130")).select(df.columns))
    assert rows(V.neighbour_pairs(again, shard_rows=40, relax=1.0, leaf_rows=8, many_copies=100)) == got
    # another, greater vector of id 5 changes nothing; the same row again neither
    again = spark.createDataFrame([(5, "classical-descriptor", [9.0] * 368, 0, "z")], DESC)
    assert rows(V.neighbour_pairs(df.unionAll(again).unionAll(df.where("vec_id < 50")), shard_rows=40, relax=1.0)) == got


def test_vectors_go_only_to_shards_they_may_reach():
    r = np.random.default_rng(3)
    centre = V._unit(r.normal(0, 1, (64, 368)))
    v = V._unit(np.repeat(centre, 20, axis=0) + r.normal(0, 0.01, (1280, 368))).astype(np.float32)
    lay = V.Layout({0: v[::20]}, 0.8, V.RELAX)
    d = lay.distances(0, v)
    home = d.argmin(axis=1)
    lay.deal({(0, int(c)): int(n) for c, n in zip(*np.unique(home, return_counts=True))}, 40)
    reached = lay.reached(d, d.min(axis=1))
    assert lay.shards == 32 and reached.sum(axis=1).mean() < 1.5
    assert reached[np.arange(len(v)), home].all()
