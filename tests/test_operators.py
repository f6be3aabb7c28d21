import random

from pyspark.sql import functions as F

from tests.conftest import rows
from twinlens.operators import classify, components, dedupe, filtering, merge, report
from twinlens.operators.skew import salted_join


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, None, "n"), (5, None, "m")], "seq int, k string, v string")
    first, alias = dedupe.unique_and_aliases(df, F.col("k"), [F.col("seq")])
    assert rows(first, "seq") == [(1,), (2,), (4,)] and rows(alias, "seq") == [(3,), (5,)]
    assert rows(dedupe.first_per_key(df, [F.col("k")], [F.col("seq")]), "seq") == [(1,), (2,), (4,)]
    assert rows(dedupe.first_per_key(df.limit(0), [F.col("k")], [F.col("seq")])) == []
    n = dedupe.number_candidates(df.withColumn("q", F.lit(1)), "q", [F.col("seq")])
    assert rows(n, "cid", "seq")[0] == ("c00000", 1)


def _filter_by_loop(items):
    gate = lambda x: x[1] >= 0.72 or (x[2] >= 0.80 and x[1] >= 0.55)
    ranked = sorted(items, key=lambda x: (-x[1], -x[2], x[0]))
    kept = [x[0] for x in ranked if gate(x)][:60]
    for x in ranked[:24]:
        if x[0] not in kept and len(kept) < 60:
            kept.append(x[0])
    return set(kept)


def test_filter_equals_a_loop(spark):
    r = random.Random(4)
    data, want = [], set()
    for q in range(25):
        items = [(i, round(r.random() ** (0.3 if q % 3 == 0 else 1), 3), round(r.random(), 3)) for i in range(r.choice([5, 30, 120]))]
        data += [(q, i, f, c, True, None) for i, f, c in items] + [(q, 1000, None, None, False, "broken")]
        want |= {(q, i) for i in _filter_by_loop(items)}
    df = spark.createDataFrame(data, "q int, seq int, fused double, color double, ok boolean, error string")
    out = filtering.filter_candidates(df, "q")
    assert {(x["q"], x["seq"]) for x in out.where("kept").collect()} == want
    bad = out.where("seq = 1000").first()
    assert (bad["reason"], bad["kept"], bad["rank"]) == ("broken", False, None)


SIG = "hash_sim double, ssim double, nrmse_sim double, grad_corr double, emb_cos double, feat_sim double, hist_corr double, changed_fraction double, coverage_orig double, coverage_cand double, coverage_source string, aspect_sim double, orientation string, sha_identical boolean, edit_labels array<string>, align_method string"


def _sig(v=1.0, ssim=None, changed=0.0, co=1.0, cc=1.0, source="homography", aspect=1.0, turn="identity", sha=False, edits=()):
    return (v, v if ssim is None else ssim, v, v, v, v, v, changed, co, cc, source, aspect, turn, sha, list(edits), "coextensive")


def test_every_branch_of_the_verdict(spark):
    cases = [
        (_sig(0.1, sha=True), "EXACT_1TO1"),
        (_sig(0.95, co=0.25), "CROP"),
        (_sig(0.95, edits=["brightness"]), "EDITED_1TO1"),
        (_sig(0.95, turn="rot90"), "EDITED_1TO1"),
        (_sig(0.95, cc=0.8), "EDITED_1TO1"),
        (_sig(0.99), "EXACT_1TO1"),
        (_sig(0.99, edits=["recompressed"]), "EXACT_1TO1"),
        (_sig(0.88), "NEAR_1TO1"),
        (_sig(0.95, changed=0.5), "VISUALLY_SIMILAR"),
        (_sig(0.3), "UNRELATED"),
        (_sig(0.6, ssim=0.2), "UNRELATED"),
        (_sig(0.95, source="none"), "CROP"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], SIG).coalesce(1)
    got = classify.reasons(classify.verdict_columns(df)).collect()
    assert [r["label"] for r in got] == [w for _, w in cases]
    assert got[0]["confidence"] == 100.0 and all(0 < r["confidence"] <= 100 for r in got)
    assert all(r["reasons"] for r in got)
    assert got[1]["overlap"] == 0.25 and got[9]["overlap"] is None
    assert classify.error_verdict(df.limit(1).drop("label"), F.lit("x")).first()["label"] == "ERROR"


def test_components_against_union_find(spark):
    r = random.Random(8)
    for kind in range(3):
        pairs = [(i, i + 1) for i in range(1, 40)] if kind == 0 else [(r.randint(1, 60), r.randint(1, 60)) for _ in range(50)] if kind == 1 else [(100, i) for i in range(40)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = rows(components.connected_components(spark.createDataFrame(pairs + [(None, 1)], "a int, b int"), "a", "b"), "node", "component")
        assert got == sorted((x, find(x)) for x in list(parent))


def test_band_pairs_equal_nested_loop(spark):
    r = random.Random(2)
    data = [("r", f"c{i:02d}", round(r.random(), 2)) for i in range(60)] + [("r", "x", None)]
    got = rows(merge.band_pairs(spark.createDataFrame(data, "run string, cid string, overlap double"), ["run"], "overlap", "cid"), "cid_a", "cid_b")
    want = sorted((a[1], b[1]) for a in data for b in data if a[1] < b[1] and a[2] is not None and b[2] is not None and round(abs(a[2] - b[2]), 9) <= 0.05)
    assert got == want


def test_salted_join_equals_plain_join(spark):
    big = spark.range(300).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    got = rows(salted_join(big, small, "k", "n", F.col("id"), hot_rows=20, salts=5), "k", "id", "n")
    assert got == rows(big.join(small, "k"), "k", "id", "n")


def test_engines(spark):
    e = spark.createDataFrame([("a", "A", True), ("b", "B", False), ("c", "C", True)], "engine string, display_name string, available boolean")
    sel = lambda names: [r[0] for r in rows(report.select_engines(e, names), "engine")]
    assert sel([]) == ["a", "c"] and sel(["c", "zz"]) == ["c"] and sel(["b"]) == ["a", "c"]
    hits = spark.createDataFrame([("a",), ("a",)], "engine string")
    assert rows(report.engine_outcomes(hits, e), "engine", "count") == [("a", 2), ("b", 0), ("c", 0)]


def test_ranks_of_a_hot_group(spark):
    from twinlens.operators.ranking import spread_rank

    r = random.Random(2)
    data = [("hot" if i % 2 else r.choice(["a", "b", None]), round(r.random(), 2), i, r.random() < 0.3) for i in range(600)]
    df = spark.createDataFrame(data, "g string, score double, i int, flag boolean")
    out = spread_rank(df, ["g"], -F.floor(F.col("score") * 50), [F.desc("score"), F.col("i")], "rank", {"flags": F.col("flag").cast("int")})
    got = {x["i"]: (x["rank"], x["flags"], x["total_flags"]) for x in out.collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        n = 0
        own = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
        for k, x in enumerate(own):
            n += x[3]
            want[x[2]] = (k + 1, n, sum(y[3] for y in own))
    assert got == want


def test_pairs_to_compare(spark):
    rows_ = [
        ("q", "EXACT_1TO1", "a", None, "s1"), ("q", "EXACT_1TO1", "b", None, "s1"), ("q", "EXACT_1TO1", "c", None, "s2"), ("q", "EXACT_1TO1", "d", None, ""),
        ("q", "CROP", "e", 0.30, "s3"), ("q", "CROP", "f", 0.34, "s4"), ("q", "CROP", "g", 0.60, "s5"), ("q", "CROP", "h", 0.60, "s5"),
        ("q", "UNRELATED", "i", None, "s1"), ("r", "EXACT_1TO1", "j", None, "s1"), ("q", "NEAR_1TO1", "k", None, "s1"),
    ]
    df = spark.createDataFrame(rows_, "query_id string, label string, cid string, overlap double, sha256 string")
    want = [("a", "b", True), ("a", "c", False), ("a", "d", False), ("c", "d", False), ("e", "f", False), ("g", "h", True)]
    assert rows(merge.pairs_to_compare(df), "cid_a", "cid_b", "same_bytes") == want


def test_exact_percentiles(spark):
    from twinlens.operators.ranking import percentiles

    r = random.Random(5)
    data = [(g, r.choice([None, round(r.random() * 9, 2)])) for g in "ab" for _ in range(101)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = percentiles(df, "g", "v", {"m": 0.5, "p": 0.95}, F.floor(F.col("v")))
    want = df.where("v IS NOT NULL").groupBy("g").agg(F.median("v").alias("m"), F.percentile("v", 0.95).alias("p"))
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in t) for t in rows(got, "g", "m", "p")] == [tuple(round(x, 9) if isinstance(x, float) else x for x in t) for t in rows(want, "g", "m", "p")]
