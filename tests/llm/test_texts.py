import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from twinlens.llm import bpe, packing, spans

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, it's 42!",
    "'s's 'll're don't I'LL we've'd  'tis \n's x''s",
    "a\n\n b\t c  ",
    "  ",
    "\n",
    "'",
    "<|endoftext|> is text",
    "日本語のテキスト" * 30,
    "a" * 3000,
    "ab" * 700 + "-" * 700,
    "　x \x1c y \x85z",
    "naïve café Ünïcödé ½ ²",
    "emoji 👩‍👩‍👧 ok",
    "x" * 20 + "\r\n" + "=" * 78 + "\r\nQUJD" * 40,
]


def test_encoder_equals_reference(reference):
    enc = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    ids, n = enc.encode(TEXTS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(t) for t in TEXTS]


def test_long_words_of_any_make(reference):
    r = random.Random(6)
    texts = ["a" * 100_000, "ab" * 9000, "-" * 5001, "日本" * 4000]
    for letters in ("ab", "abc", "etaoin", "thein", "lo"):
        texts += ["".join(r.choice(letters) for _ in range(n)) for n in (40, 300, 1500)]
        texts += [("".join(r.choice(letters) for _ in range(k)) * 400)[:2000] for k in (2, 3, 5, 7, 11)]
    ids, n = bpe.Encoder(open(bpe.VOCABULARY, "rb").read()).encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == reference.encode_ordinary(t), t[:50]


def test_words_of_one_hash_are_told_apart(reference, monkeypatch):
    monkeypatch.setattr(bpe, "span_hash", lambda prefix, a, b: ((b - a) % 3).astype(np.uint64))
    enc = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    for _ in range(2):
        ids, n = enc.encode(TEXTS)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(t) for t in TEXTS]


def test_encoder_forgets_and_goes_on(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    enc = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    for t in texts:
        assert enc.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_encode_column_defined_cases(spark, reference):
    df = spark.createDataFrame([(1, "a b", 7), (2, "", 7), (3, None, 7), (1, "a b", 7), (None, "q", 7)], "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in bpe.encode_column(df).collect())
    ab = reference.encode_ordinary("a b")
    assert got == sorted([(0, reference.encode_ordinary("q")), (1, ab), (1, ab), (2, []), (3, [])])
    assert bpe.encode_column(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in bpe.count_tokens(df).collect()) == sorted([len(ab), len(ab), 0, 0, 1])


def _check(histogram, capacity):
    kinds = packing.plan_containers(histogram, capacity)
    used = {}
    for count, contents in kinds:
        assert count > 0 and sum(s * k for s, k in contents) <= capacity
        for s, k in contents:
            used[s] = used.get(s, 0) + count * k
    assert used == {s: n for s, n in histogram.items() if n}
    return sum(c for c, _ in kinds)


def test_plan_holds_everything_and_is_tight():
    r = random.Random(5)
    for capacity in (10, 64, 2048):
        for _ in range(20):
            h = {}
            for _ in range(r.randint(1, 400)):
                s = r.randint(1, capacity)
                h[s] = h.get(s, 0) + r.choice([1, 1, 3, 50])
            bins = _check(h, capacity)
            least = -(-sum(s * n for s, n in h.items()) // capacity)
            assert bins >= least
            first_fit = []
            for s in sorted((s for s, n in h.items() for _ in range(n)), reverse=True):
                for i, free in enumerate(first_fit):
                    if free >= s:
                        first_fit[i] -= s
                        break
                else:
                    first_fit.append(capacity - s)
            assert bins <= len(first_fit) * 1.02 + 1
    assert packing.plan_containers({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan_containers({11: 1}, 10)


def test_fill_containers_cases(spark):
    data = [(i, n, 9) for i, n in enumerate([5, 5, 5, 0, 10, 23, 3, 3, 4, 20, 1, 1, 7, 25])] + [(None, 4, 9), (3, None, 9), (6, 3, 9)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, size int")
    got = packing.fill_containers(df, 10).collect()
    per = {}
    for r in got:
        per.setdefault(r["container"], []).append(r)
    assert sorted(per) == list(range(len(per)))
    for items in per.values():
        items.sort(key=lambda r: r["place"])
        assert [r["place"] for r in items] == list(range(len(items)))
        at = 0
        for r in items:
            assert r["start"] == at
            at += r["n_tokens"]
        assert at <= 10
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n, _ in data)
    assert sorted((r["piece"], r["n_tokens"]) for r in got if r["doc_id"] == 5) == [(0, 10), (1, 10), (2, 3)]
    assert len(per) <= -(-sum(n or 0 for _, n, _ in data) // 10) + 1
    assert packing.fill_containers(df.limit(0), 10).count() == 0


# ---- shared spans -------------------------------------------------------------------------------------


def brute(docs, m):
    owner = {}
    for d, t in docs:
        for i in range(len(t) - m + 1):
            w = t[i : i + m]
            owner[w] = d if owner.get(w, d) == d else -1
    out = []
    for d, t in dict(docs).items():
        covered = set()
        for i in range(len(t) - m + 1):
            if owner[t[i : i + m]] == -1:
                covered |= set(range(i, i + m))
        if covered:
            out.append((d, len(t), len(covered)))
    return sorted(out)


def _corpus(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日\n ") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(8)]
    out = []
    for d in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t += r.choice([p, p[a:], p[:a], " ".join(word() for _ in range(20)), "-" * r.randint(0, 90)])
        out.append((d, t))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_shared_spans_against_brute_force(spark, hot):
    docs = _corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, doc int")
    got = rows(spans.shared_share(df, 40, gram=9, hot_seeds=hot), "doc_id", "chars", "shared_chars")
    want = brute(docs, 40)
    assert len(want) > 20 and got == want


def test_shared_spans_defined_cases(spark):
    p = "".join(chr(97 + i * i % 26) for i in range(300))
    data = [(1, p), (1, p), (2, None), (3, ""), (4, "x" * 50), (None, p), (5, p + p), (6, "q" * 500)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(spans.shared_share(df)) == [(1, 300, 300), (5, 600, 600)]
    only = spark.createDataFrame([(1, p + "!" + p), (None, p)], "doc_id bigint, text string")
    assert rows(spans.shared_share(only)) == []
    assert rows(spans.shared_share(df.limit(0))) == []


def test_very_long_text_is_cut_with_overlap(monkeypatch):
    r = random.Random(9)
    t = "".join(r.choice("abcdef ") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([t])], names=["doc", "text"])
    whole = pa.Table.from_batches(spans._find_seeds(50, 8)(iter([batch]))).to_pandas()
    monkeypatch.setattr(spans, "SEGMENT_CHARS", 300)
    cut = pa.Table.from_batches(spans._find_seeds(50, 8)(iter([batch]))).to_pandas()
    windows = lambda x: sorted(i for a, n in zip(x["start"], x["n"]) for i in range(a, a + n))
    assert windows(whole) == windows(cut) == list(range(4951))
    assert set(whole["body"]) == set(cut["body"]) and len(set(whole["body"])) == 1


def test_windows_of_one_hash_are_compared(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(120)) for _ in range(6)]
    texts += [texts[0][10:70], texts[1][5:100], texts[2]]
    n = np.array([len(t) - 20 + 1 for t in texts])
    c, row, j, at = spans._windows(texts, n, 20)
    monkeypatch.setattr(spans, "span_hash", lambda p, a, b: p[a] % np.uint64(5))
    order, edge = spans._equal_windows(c, row, at, 20)
    text = "".join(texts)
    got = {frozenset(x.tolist()) for x in np.split(order, edge[1:])}
    want = {}
    for i, a in enumerate(at.tolist()):
        want.setdefault(text[a : a + 20], set()).add(i)
    assert got == {frozenset(x) for x in want.values()}


def test_hot_anchors_give_the_same_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain, hot = (rows(spans.shared_share(docs, hot_seeds=k)) for k in (20_000, 3))
    assert plain == hot and len(plain) > 5


def test_audit_sees_what_is_wrong(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 5, 0, 10, 23, 3, 3, 4])], "doc_id bigint, n_tokens bigint")
    placed = packing.fill_containers(sizes, 10)
    wrong = ("not_whole", "needless_splits", "over_capacity", "gaps", "unnumbered")
    good = packing.audit_containers(sizes, placed, 10).first()
    assert (good["documents"], good["filled"]) == (8, True) and not any(good[k] for k in wrong)
    lost = packing.audit_containers(sizes, placed.where("doc_id <> 1"), 10).first()
    assert lost["not_whole"] == 1
    twice = packing.audit_containers(sizes, placed.unionAll(placed.where("doc_id = 1")), 10).first()
    assert twice["not_whole"] == 1 and twice["gaps"] == 1


def test_what_the_driver_gets_is_bounded():
    histogram = {s: 1 + s * 7919 % 1000 for s in range(1, packing.CAPACITY + 1)}
    a, b = (packing._places(packing.plan_containers({s: n * k for s, n in histogram.items()})) for k in (1, 10**6))
    assert len(a["size"]) < 20_000 and len(b["size"]) < 1.1 * len(a["size"]) + 100
