import random

import pytest

from tests.conftest import rows
from twinlens.llm import groups, ledger
from pyspark.sql import functions as F


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "shuffled_chain"])
def test_groups_against_union_find(spark, kind):
    r = random.Random(3)
    n = 60
    name = [f"c{i:03d}" for i in range(n)]
    if kind == "chain":
        pairs = list(zip(name, name[1:]))
    elif kind == "star":
        pairs = [(name[-1], x) for x in name[:-1]]
    elif kind == "random":
        pairs = [(r.choice(name), r.choice(name)) for _ in range(40)]
    else:
        mixed = name[:]
        r.shuffle(mixed)
        pairs = list(zip(mixed, mixed[1:]))
    got = rows(groups.group_records(spark.createDataFrame(pairs, "a string, b string")), "member", "group")
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_half_of_all_rows_in_one_group(spark, monkeypatch):
    from twinlens.operators import components

    monkeypatch.setattr(components, "HOT_LABELS", 20)
    r = random.Random(8)
    name = [f"c{i:04d}" for i in range(600)]
    pairs = [(name[300], x) for x in r.sample(name, 300)] + [(r.choice(name), r.choice(name)) for _ in range(120)] + list(zip(name[400:], name[401:]))
    r.shuffle(pairs)
    got = rows(groups.group_records(spark.createDataFrame(pairs, "a string, b string")), "member", "group")
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_groups_defined_cases(spark):
    edges = spark.createDataFrame([("b", "a", 1), ("a", "b", 2), ("c", None, 3), ("d", "d", 4), (None, None, 5)], "a string, b string, label int")
    assert rows(groups.group_records(edges), "member", "group") == [("a", "a"), ("b", "a")]
    empty = spark.createDataFrame([], "a string, b string")
    assert rows(groups.group_records(empty)) == []
    pairs = spark.createDataFrame([("x", "y", True), ("x", "q", False), ("x", "z", None)], "cid_a string, cid_b string, is_match boolean")
    cards = spark.createDataFrame([(["y", "w", "w", None],), (["solo"],), (None,), ([],)], "member_cids array<string>")
    assert rows(groups.candidate_groups(pairs, cards)) == [("w", "w"), ("w", "x"), ("w", "y")]


SAME = [
    "https://a.example/x/y.jpg?b=1&a=caf%C3%A9",
    " HTTPS://A.example.:443/x//./y.jpg/?a=CAFé&&b=%31& ",
    "<URL:https://a.exam\r\n ple/x/%79.jpg?b\\u003d1\\u0026a=caf%c3%a9#>",
    "(https:\\/\\/a.example\\/x\\/y.jpg?a=caf%C3%A9&amp;b=1#)",
    "​https://a.example/x/y.jpg?b=1&#38;a=café;",
]
OTHER = [
    "http://a.example/x/y.jpg?b=1&a=caf%C3%A9",
    "https://b.example/x/y.jpg?b=1&a=caf%C3%A9",
    "https://a.example/x/y.jpg2?b=1&a=caf%C3%A9",
    "https://a.example/x/y.jpg?b=2&a=caf%C3%A9",
    "https://a.example/x/y.jpg?b=1&a=caf%C3%A9&utm_source=q",
    "https://a.example/x/y.jpg?b=1&a=caf%C3%A9#s3",
    "https://a.example:8080/x/y.jpg?b=1&a=caf%C3%A9",
    "https://a.example/x/y.jpg?b=1%26a=caf%C3%A9",
]


def test_addresses_written_differently(spark):
    from twinlens.llm.urlkeys import with_canonical

    df = spark.createDataFrame([(i, u) for i, u in enumerate(SAME + OTHER + [None, ""])], "i int, u string")
    got = {r["i"]: r["u"] for r in with_canonical(df, "u").collect()}
    same = {got[i] for i in range(len(SAME))}
    assert len(same) == 1
    others = [got[i] for i in range(len(SAME), len(SAME) + len(OTHER))]
    assert len(set(others) | same) == len(OTHER) + 1
    assert got[len(SAME + OTHER)] is None


def test_plus_means_space_in_queries_only(spark):
    from twinlens.llm.urlkeys import with_canonical

    df = spark.createDataFrame([("https://a.b/p?q=left+%26+right",), ("https://a.b/p?q=left%20%26%20right",), ("https://a.b/a+b",), ("https://a.b/a%2Bb",), ("https://a.b/a%20b",)], "u string")
    q1, q2, p1, p2, p3 = (r[0] for r in with_canonical(df, "u").collect())
    assert q1 == q2 and p1 == p2 != p3


def _hits(spark, data):
    return spark.createDataFrame(data, "seq bigint, url string, page_url string, loaded_at timestamp, key string, copies int")


def test_ledger_counts_once_across_batches(spark):
    from datetime import datetime

    t = [datetime(2023, 1, d) for d in (1, 5, 9)]
    data = [
        (1, SAME[0], None, t[0], "x", 1),
        (2, SAME[1], "", t[0], "x", 1),
        (2, SAME[1], "", t[2], "x", 1),  # delivered again
        (3, SAME[2], "https://p.example", t[1], "x", 1),
        (4, SAME[3], "https://P.example/", t[2], "x", 1),
        (5, None, None, t[1], "x", 1),
        (6, None, None, t[1], "x", 1),
        (7, SAME[4], None, t[2], "x", 1),
        (None, SAME[4], None, t[2], "x", 1),
        (8, OTHER[0], None, None, "x", 1),
    ]
    book = ledger.hit_ledger(_hits(spark, data))
    assert rows(book.copies()) == [(1, 2), (1, 7), (3, 4)]
    assert rows(book.representatives()) == [(1, 3), (3, 2), (8, 1)]
    assert rows(ledger.hit_ledger(_hits(spark, [])).copies()) == []


def test_ledger_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ledger.salted_join, "__defaults__", ("inner", 10, 4, None))
    data = spark.range(1, 200).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "https://a.b/hot").otherwise(F.concat(F.lit("https://a.b/"), "id")).alias("url"), F.lit(None).cast("string").alias("page_url"), F.current_timestamp().alias("loaded_at"))
    got = rows(ledger.hit_ledger(data).copies())
    assert got == [(3, s) for s in range(6, 200, 3)]


def test_record_key_sets_formatting_aside(spark):
    df = spark.createDataFrame([("Ann  Lee", "x-1"), ("X 1", "ann lee!"), ("ann", "leex1"), (None, "x")], "a string, b string")
    k = [r[0] for r in df.select(ledger.record_key(F.col("a"), F.col("b"))).collect()]
    assert k[0] == k[1] and k[2] != k[0] and k[3] is not None


def test_a_batch_touches_only_its_buckets(spark):
    book = ledger.CopyLedger(spark, buckets=16)
    first = spark.range(1, 400).select(F.col("id").alias("seq"), F.encode(F.concat(F.lit("k"), F.col("id") % 150), "utf-8").alias("key"))
    book.update(first, F.col("seq"), F.col("key"))
    before, members = dict(book._ledger), {k: list(v) for k, v in book._members.items()}
    assert len(before) == 16
    second = spark.createDataFrame([(1000, b"k7"), (7, b"k7"), (1000, b"k7")], "seq bigint, key binary")
    book.update(second, F.col("seq"), F.col("key"))
    changed = [b for b in before if book._ledger[b] != before[b]]
    assert len(changed) == 1
    # unchanged buckets keep their files, and old members are never written again
    assert all(book.ws.folders(f.rsplit("/", 1)[0]) for f in before.values())
    assert all(book._members[b][: len(v)] == v for b, v in members.items()) and sum(map(len, book._members.values())) == sum(map(len, members.values())) + 1
    got = {r["first_seq"]: r["copies"] for r in book.representatives().collect()}
    assert got[7] == 4 and len(got) == 150 and sum(got.values()) == 400
