import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlens.kernels.pixels import png_encode
from twinlens.operators import images
from twinlens.plans import pictures
from twinlens.sources import connectors, demo, engines
from twinlens.sources import images as I

A = png_encode(demo.scene(width=160, height=120, shapes=40))


def test_bad_rows_carry_an_error(spark):
    df = spark.createDataFrame([(1, bytearray(A)), (2, bytearray(b"junk")), (3, bytearray(b"")), (4, None)], "id int, data binary")
    got = {r["id"]: r for r in images.fingerprints(df, ["id"]).collect()}
    assert got[1]["error"] is None and got[1]["width"] == 160 and len(got[1]["color_hist"]) == 64
    assert all(got[i]["error"] and got[i]["phash"] is None for i in (2, 3, 4))


def test_inline_data_and_corpus(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    for n in ("b.png", "sub/a.PNG", "note.txt"):
        (tmp_path / n).write_bytes(A if n != "note.txt" else b"x")
    corpus = I.folder_hits(spark, str(tmp_path))
    assert rows(corpus.where("engine_label <> '' AND page_url LIKE 'file:///%'"), "url", "title") == [("/corpus/b.png", "b"), ("/corpus/sub/a.PNG", "a")]
    hits = spark.createDataFrame([(1, "/corpus/b.png"), (2, "https://x/y"), (3, "data:image/png;base64,QUJD"), (4, "data:x;base64,"), (5, None)], "id int, url string")
    got = {r["id"]: (bytes(r["data"]) if r["data"] is not None else None, r["error"]) for r in I.load_bytes(hits, corpus).collect()}
    assert got[1] == (A, None) and got[2] == (None, "not fetched") and got[3] == (b"ABC", None) and got[4] == (None, "empty file") and got[5][0] is None


def test_decode_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(A)
    (tmp_path / "z.png").write_bytes(b"garbage")
    got = {os.path.basename(r["path"]): r for r in I.decode_folder(spark, str(tmp_path)).collect()}
    assert got["a.png"]["width"] == 160 and (I.read_rgb(bytes(got["a.png"]["data"])) == I.read_rgb(A)).all()
    assert got["z.png"]["error"] == "undecodable" and got["z.png"]["sha256"]


def test_connectors(spark):
    tags = '{"tags":[{"actions":[{"data":{"value":[{"contentUrl":"https://a/1.png","hostPageUrl":"https://p","name":"n","thumbnail":{"width":3,"height":4}},{"hostPageUrl":"https://q"},{}]}}]},{"actions":null}]}'
    df = spark.createDataFrame([("e", tags), ("e", None), ("e", "no json"), ("e", "")], "engine string, body string")
    urls = [r[0] for r in rows(connectors.hits_from_tags(df), "url")]
    assert urls == ["https://a/1.png", "https://q"]
    match = '{"result":{"matches":[{"image_url":"https://i/1","score":7.5,"backlinks":[{"url":"https://u","backlink":"https://b"},{"url":"https://no"}]},{"image_url":"https://i/2","backlinks":[]}]}}'
    got = rows(connectors.hits_from_matches(df.limit(1).withColumn("body", F.lit(match))), "url", "engine_label")
    assert got == [("https://i/2", "match"), ("https://u", "match 7.5")]
    page = 'x "https:\\/\\/h.com\\/a.jpg" y https://h.com/a.jpg z https://static.example/b.png https://k/c.webp?w\\u003d1'
    got = connectors.number_hits(connectors.hits_from_page(df.limit(1).withColumn("body", F.lit(page)), ["static.example"]))
    assert rows(got, "seq", "url") == [(1, "https://h.com/a.jpg"), (2, "https://k/c.webp")]


def test_engine_source_survives_a_failing_engine(spark):
    def broken(image):
        raise RuntimeError("down")

    engines.register("broken", broken)
    engines.register("two", lambda image: [{"url": "https://x/1"}, {"url": "https://x/2"}])
    hits, outcomes = engines.search(spark, A, ["two", "broken", "unknown"])
    assert rows(hits, "engine", "url") == [("two", "https://x/1"), ("two", "https://x/2")]
    assert rows(outcomes, "engine", "count", "error") == [("broken", 0, "down"), ("two", 2, None)]


def test_case_matrix(spark):
    got = {r["name"]: r for r in pictures.case_matrix(spark, "").collect()}
    cases = demo.cases(demo.scene())
    wrong = [(n, got[n]["label"]) for n, _, e in cases if got[n]["label"] != e]
    assert len(got) == len(cases) == 28 and not wrong
    assert sorted(n for n, r in got.items() if r["covers_as_cut"]) == ["crop_centre", "crop_corner", "crop_wide"]


def test_demo_pipeline(spark):
    r = pictures.demo_report(spark)
    cards = {c["card_key"]: c for c in r.cards.collect()}
    labels = [c["label"] for c in cards.values()]
    assert labels.count("EXACT_1TO1") == 1 and "CROP" in labels and "UNRELATED" in labels
    exact = next(c for c in cards.values() if c["label"] == "EXACT_1TO1")
    assert exact["sources"] >= 5 and len(exact["engines"]) == 3
    look = next(c for c in cards.values() if c["best_url"].endswith("lookalike.png"))
    assert look["label"] not in ("EXACT_1TO1", "NEAR_1TO1", "EDITED_1TO1")
    n = r.counts().first()
    assert n["raw_results"] > n["unique_urls"] == n["downloaded"] and n["one_to_one"] >= 3


def test_api(spark, tmp_path):
    from twinlens import api

    engines.register("copies", lambda image: [{"url": "https://x/1.png", "data": image}, {"url": "https://x/1.png?again", "data": image}, {"url": "https://x/bad.png", "data": b"no"}])
    run = api.search(spark, A, names=["copies"])
    s = run.status().first()
    assert (s["raw_results"], s["unique_urls"], s["failed_downloads"], s["merged_cards"], s["one_to_one"]) == (3, 2, 1, 1, 1)
    card = run.cards().first()
    assert card["confidence"] == 100.0 and card["sources"] == 2
    assert bytes(run.view("q1", card["representative_cid"], "difference", 32).first()["png"])[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        run.view("q1", "c00000", "other")
    run.store(str(tmp_path / "run"))
    assert bytes(spark.read.parquet(str(tmp_path / "run" / "originals")).first()["data"]) == A
    assert {d: spark.read.parquet(str(tmp_path / "run" / d)).count() for d in ("hits", "uniques", "prints", "verdicts", "cards")} == {"hits": 3, "uniques": 2, "prints": 2, "verdicts": 1, "cards": 1}
    assert api.list_thresholds(spark).count() == 8 and api.list_engines(spark).count() >= 2


def test_files_of_other_formats(spark, tmp_path):
    from twinlens.kernels import compare as C
    from twinlens.kernels.jpeg import jpeg_encode

    a = I.read_rgb(A)
    jvm = spark._jvm
    (tmp_path / "a.png").write_bytes(A)
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.png")))
    data = [("png", A), ("jpg", jpeg_encode(a, 92)), ("exif", jpeg_encode(a.transpose(1, 0, 2)[::-1], 95, 6)), ("broken", b"\xff\xd8\xffno"), ("empty", b""), ("null", None), ("again", jpeg_encode(a, 92))]
    for kind in ("gif", "bmp", "tiff"):
        jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(tmp_path / f"a.{kind}")))
        data.append((kind, (tmp_path / f"a.{kind}").read_bytes()))
    df = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in data], "name string, data binary")
    got = {r["name"]: r["data"] for r in I.normalised(df).collect()}
    assert len(got) == len(data) and bytes(got["broken"]) == b"\xff\xd8\xffno" and got["null"] is None and bytes(got["empty"]) == b"" and bytes(got["png"]) == A
    for name, least in (("jpg", 30), ("exif", 30), ("again", 30), ("gif", 20), ("bmp", 99), ("tiff", 99)):
        assert C.psnr(I.read_rgb(bytes(got[name])), a) > least, name


def test_jpeg_round_trip(spark, tmp_path):
    from twinlens.kernels import compare as C
    from twinlens.kernels.jpeg import jpeg_encode

    a = demo.scene(width=93, height=61, shapes=20)
    for q in (10, 50, 90, 100):
        (tmp_path / f"{q:03d}.jpg").write_bytes(jpeg_encode(a, q))
    (tmp_path / "flat.jpg").write_bytes(jpeg_encode(a[:8, :8] * 0 + 200, 75))
    got = {os.path.basename(r["path"]): I.read_rgb(bytes(r["data"])) for r in I.decode_folder(spark, str(tmp_path)).collect()}
    quality = [C.psnr(got[f"{q:03d}.jpg"], a) for q in (10, 50, 90, 100)]
    assert quality == sorted(quality) and quality[0] > 22 and quality[-1] > 42 and abs(got["flat.jpg"].astype(int) - 200).max() <= 1


def test_addresses_are_fetched_within_limits(spark, monkeypatch):
    def fetch(url):
        if "gone" in url:
            raise OSError("404")
        return {"https://x/a": ("image/png; charset=x", A), "https://x/text": ("text/html", b"<html>"), "https://x/huge": ("image/png", b"0" * (24 << 20) + b"1"), "https://x/none": ("", b"")}[url]

    urls = ["https://x/a", "https://x/a", "https://x/text", "https://x/huge", "https://x/none", "https://x/gone", "data:image/png;base64,QUJD", None]
    hits = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r["id"]: (None if r["data"] is None else bytes(r["data"]), r["error"]) for r in I.load_bytes(hits, fetch=fetch).collect()}
    assert got[0] == got[1] == (A, None) and got[2] == (None, "not an image: text/html") and got[3] == (None, "too large") and got[4] == (None, "empty file")
    assert got[5] == (None, "download failed: 404") and got[6] == (b"ABC", None) and got[7] == (None, "no data")


def test_folder_without_images_and_the_query_itself(spark, tmp_path):
    import hashlib

    with pytest.raises(ValueError):
        I.folder_hits(spark, str(tmp_path))
    (tmp_path / "q.png").write_bytes(A)
    (tmp_path / "r.png").write_bytes(png_encode(demo.unrelated(1, 64, 48)))
    sha = hashlib.sha256(A).hexdigest()
    assert rows(I.folder_hits(spark, str(tmp_path), query_sha=sha), "title") == [("r",)]


def test_engines_that_take_an_upload(spark):
    asked = []

    def send(step, url, image):
        asked.append((step, url, image))
        return {"upload": "see /upload/abcdefghij0123456789xyz now", "results": "page", "visit": ""}[step]

    got = connectors.page_search(b"img", send, "https://e/upload", "https://e/r?p=/upload/{token}", warm_url="https://e/")
    assert got == "page" and [a[0] for a in asked] == ["visit", "upload", "results"] and asked[-1][1].endswith("/upload/abcdefghij0123456789xyz")
    named = connectors.page_search(b"img", lambda s, u, i: '{"uploaded-image": "n1"}' if s == "upload" else u, "u", "r={token}", token="name")
    assert named == "r=n1"
    for answer, token in (("nothing", "id"), ("{}", "name"), ("no json", "name"), ("[]", "name")):
        with pytest.raises(ValueError):
            connectors.page_search(b"img", lambda *a, answer=answer: answer, "u", "{token}", token=token)
    with pytest.raises(ValueError):
        connectors.answer_search(b"img", send, "https://e", None)
    df = spark.createDataFrame([("a",), ("b",)], "engine string")
    hits = df.where("engine = 'a'").select("engine")
    assert rows(connectors.hits_or_failure(hits, df)) == [("b", "no results that can be read")]


def test_runs_of_several_queries_at_once(spark):
    from twinlens.kernels.jpeg import jpeg_encode
    from twinlens.plans import pipeline

    a = demo.scene(width=200, height=150, shapes=50)
    jpeg = jpeg_encode(a, 92)
    hits = []

    def add(query, url, engine, page, data):
        hits.append((query, len(hits) + 1, url, engine, "", page, "", bytearray(data)))

    for k in range(3):  # the same bytes from three engines
        add("bytes", f"https://h{k}.example/x.jpg", f"e{k}", f"https://p{k}.example", jpeg)
    for k in range(5):  # one address five times
        add("address", f"https://h.example/x.png?utm_source={k}", "e1", f"https://p{k}.example", png_encode(a))
    for k in range(8):
        add("others", f"https://h.example/{k}.png", "e1", "", png_encode(demo.unrelated(50 + k, 200, 150)))
    add("broken", "https://h.example/b.jpg", "e1", "", jpeg[:50])
    rows_ = spark.createDataFrame(hits, "query_id string, seq bigint, url string, engine string, engine_label string, page_url string, title string, data binary")
    originals = spark.createDataFrame([(q, bytearray(png_encode(a))) for q in ("bytes", "address", "others", "broken")], "query_id string, data binary")
    r = pipeline.run(originals, rows_)
    n = {x["query_id"]: x for x in r.counts().collect()}
    cards = {}
    for c in r.cards.collect():
        cards.setdefault(c["query_id"], []).append(c)
    (same,), (once,) = cards["bytes"], cards["address"]
    assert same["label"] == "EXACT_1TO1" and len(same["engines"]) == 3 and len(same["pages"]) == 3
    assert once["confidence"] == 100.0 and len(once["pages"]) == 5 and n["address"]["unique_urls"] == 1
    assert n["others"]["one_to_one"] == 0 and n["others"]["verified"] == 0 and n["others"]["raw_results"] == 8
    assert n["broken"]["failed_downloads"] == 1 and "broken" not in cards
