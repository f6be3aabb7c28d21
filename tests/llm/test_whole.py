from tests.conftest import rows


def _query(name):
    import __spark_entry__ as e

    return e.queries()[name]


def test_found_records_are_projected_from_whole_ones(spark, tmp_path):
    cards = [("k", ["a", "b", "c"])]
    cands = [(c, f"e{c}", None, f"u{c}", 10, 10, None, "p1", "l1") for c in "abc"]
    spark.createDataFrame(cards, "card_key string, member_cids array<string>").write.parquet(str(tmp_path / "cards.parquet"))
    fields = "cid string, engine string, error string, url string, width int, height int, fetched_at timestamp, page_url string, engine_label string"
    spark.createDataFrame(cands, fields).write.parquet(str(tmp_path / "candidates.parquet"))
    got = _query("p3_found")(spark, str(tmp_path))
    assert rows(got) == [("k", "a", "a")]
    behind = spark.read.parquet(*got.inputFiles())
    assert rows(behind, "card_key", "pages", "first_page", "labels", "first_label") == [("k", 1, "p1", 1, "l1")]


def test_repeated_ids_take_no_places(spark):
    import numpy as np

    from tests.llm.test_minmax_vectors import DESC, nearest
    from twinlens.llm import vptree as V

    r = np.random.default_rng(3)
    v = (r.normal(0, 1, 368) + r.normal(0, 0.3, (30, 368))).astype(np.float32)
    once = [(i + 1, "classical-descriptor", [float(y) for y in x], 0, "z") for i, x in enumerate(v)]
    often = once + once[:3] * 12
    want = nearest(list(range(1, 31)), v, 10, 0.8)
    # a greater vector of the same id doesn't count
    other = [(4, "classical-descriptor", [1e6] + [0.0] * 367, 0, "z")]
    for shard in (10_000, 16):
        got = rows(V.neighbour_pairs(spark.createDataFrame(often + other, DESC), shard_rows=shard, relax=1.0, leaf_rows=8))
        assert got == want
    near = V.nearest_neighbours(spark.createDataFrame(often, DESC), relax=1.0)
    assert near.count() == 300
