"""Queries over the tables for the operators that SQL can state, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions import hashes as H
from twinlens.functions import urls as U
from twinlens.operators import dedupe as D
from twinlens.operators import filtering, merge, ranking, report
from twinlens.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- strings -------------------------------------------------------------------------------

CANON = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '[?#].*$', '', 's'), '/+$', ''), '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)$', '\1/'))"""


@query(f"SELECT seq, {CANON} AS canon FROM hits")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select("seq", U.canonical_url(F.col("url")).alias("canon"))


@query(
    r"""SELECT cid, lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme,
    lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(lower(regexp_extract(url, '^([^?#]*)', 1)), '(\.(?:jpeg|webp|tiff|jpg|png|gif|bmp|tif))$', 1) AS suffix FROM candidates"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "candidates").select(
        "cid", U.scheme(url).alias("scheme"), U.host(url).alias("host"), U.file_suffix(F.regexp_extract(url, r"^([^?#]*)", 1)).alias("suffix")
    )


@query(
    r"""WITH s AS (SELECT cid, url, lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme, error FROM candidates)
    SELECT cid, CASE WHEN scheme = 'data' THEN 'data' WHEN scheme = 'corpus' OR starts_with(url, '/corpus/') THEN 'corpus'
      WHEN scheme IN ('http', 'https') THEN 'http' ELSE 'unsupported' END AS route,
    lower(trim(coalesce(error, ''))) = '' OR regexp_matches(lower(trim(error)), '^(image/|application/octet-stream|binary/)') AS allowed FROM s"""
)
def fetch_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cid", U.fetch_route(F.col("url")).alias("route"), U.content_type_allowed(F.col("error")).alias("allowed"))


@query(
    """WITH p AS (SELECT doc_id, '/corpus' || CASE doc_id % 4 WHEN 0 THEN '/' || source WHEN 1 THEN '2/' || source WHEN 2 THEN '' ELSE '/../' || source END AS path FROM documents)
    SELECT doc_id, path, path = '/corpus' OR (starts_with(path, '/corpus/') AND NOT contains(path, '/../')) AS inside FROM p"""
)
def path_containment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, F.concat(F.lit("/"), "source")).when(k == 1, F.concat(F.lit("2/"), "source")).when(k == 2, "").otherwise(F.concat(F.lit("/../"), "source"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/corpus"), tail).alias("path"))
    return docs.withColumn("inside", U.inside(F.col("path"), F.lit("/corpus/")))


_BITS = {h: f"regexp_extract(lower(trim({h}, ' \t\r\n')), '^(?:0x)?([0-9a-f]{{1,16}})$', 1)" for h in ("ahash", "dhash", "phash", "whash")}


@query(
    "SELECT cid, "
    + ", ".join(f"CASE WHEN {x} <> '' THEN lpad(format('{{:x}}', CAST('0x' || {x} AS UBIGINT)), 16, '0') END AS {h}" for h, x in _BITS.items())
    + " FROM candidates"
)
def hash_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cid", *(H.to_hex(H.from_hex(_trimmed(h))).alias(h) for h in _BITS))


def _trimmed(h: str):
    return F.regexp_replace(h, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _prints(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.withColumns({h: H.from_hex(_trimmed(h)) for h in H.ORDER})


_PRINTS = "prints AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN {x} <> '' THEN CAST('0x' || {x} AS UBIGINT) END AS {h}" for h, x in _BITS.items()) + ") FROM candidates)"
_HAM = {h: f"CAST(bit_count(xor(a.{h}, b.{h})) AS INTEGER)" for h in H.ORDER}


@query(
    f"""WITH {_PRINTS}, r AS (SELECT * FROM prints WHERE ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL),
    o AS (SELECT run_id, min(cid) AS cid FROM r GROUP BY run_id),
    s AS (SELECT b.run_id, b.cid, {", ".join(f"1.0::DOUBLE - {x} / 64.0::DOUBLE AS {h}" for h, x in _HAM.items())}, {_HAM["phash"]} AS phash_bits
      FROM o JOIN r a ON a.cid = o.cid JOIN r b ON b.run_id = o.run_id)
    SELECT run_id, cid, phash_bits, round(0.45*phash + 0.25*dhash + 0.20*whash + 0.10*ahash, 9) AS fused, round(greatest(ahash, dhash, phash, whash), 9) AS best,
      round(least(ahash, dhash, phash, whash), 9) AS worst,
      CASE greatest(ahash, dhash, phash, whash) WHEN ahash THEN 'ahash' WHEN dhash THEN 'dhash' WHEN phash THEN 'phash' ELSE 'whash' END AS best_name FROM s"""
)
def hash_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate against the original of its run (here the least readable one)."""
    rows = _prints(spark, d).select("run_id", "cid", *H.ORDER).dropna(subset=H.ORDER)
    original = rows.groupBy("run_id").agg(F.min_by(F.struct(*H.ORDER), "cid").alias("o"))
    pairs = rows.join(original, "run_id")
    got = H.compare({h: F.col("o")[h] for h in H.ORDER}, {h: F.col(h) for h in H.ORDER})
    return pairs.select(
        "run_id",
        "cid",
        H.hamming(F.col("o")["phash"], F.col("phash")).alias("phash_bits"),
        *(F.round(got[k], 9).alias(k) for k in ("fused", "best", "worst")),
        got["best_name"].alias("best_name"),
    )


@query(
    f"""WITH {_PRINTS} SELECT cid, ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL AS usable,
    CASE WHEN ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL THEN 64 END AS bins FROM prints"""
)
def hash_rehydrate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    text = F.to_json(F.struct("sha256", "width", "height", *(_trimmed(h).alias(h) for h in H.ORDER), "luma_mean", "luma_std"))
    rows = c.select("cid", H.rehydrate(text).alias("h"), *(H.from_hex(_trimmed(h)).alias(h) for h in H.ORDER))
    return rows.select("cid", F.expr("ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL").alias("usable"), F.size("h.color_hist").alias("bins"))


# ---- stage 1 and 2: deduplication and numbering ------------------------------------------------

_CLEAN_HITS = f"h AS (SELECT *, {CANON} AS canon FROM (SELECT DISTINCT ON (seq) * FROM hits ORDER BY seq, loaded_at) WHERE url IS NOT NULL)"
_RANKED_HITS = f"{_CLEAN_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, canon ORDER BY seq) AS n FROM h)"


def _clean_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits")
    once = D.first_per_key(hits, [F.col("seq")], [F.col("loaded_at")])
    return once.where(F.col("url").isNotNull()).withColumn("canon", U.canonical_url(F.col("url")))


@query(f"WITH {_RANKED_HITS} SELECT run_id, canon, seq FROM r WHERE n = 1")
def stage1_uniques(spark: SparkSession, d: str) -> DataFrame:
    h = _clean_hits(spark, d).select("run_id", "canon", "seq")
    return D.first_per_key(h, [F.col("run_id"), F.col("canon")], [F.col("seq")])


@query(f"WITH {_RANKED_HITS} SELECT run_id, canon, seq FROM r WHERE n > 1")
def stage1_aliases(spark: SparkSession, d: str) -> DataFrame:
    h = _clean_hits(spark, d).select("run_id", "canon", "seq")
    _, aliases = D.unique_and_aliases(h, F.struct("run_id", "canon"), [F.col("seq")])
    return aliases


@query(
    f"""WITH {_RANKED_HITS}, u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM r WHERE n = 1)
    SELECT run_id, seq, 'c' || lpad(CAST(k - 1 AS VARCHAR), 5, '0') AS cid FROM u WHERE k <= 400"""
)
def stage1_numbered(spark: SparkSession, d: str) -> DataFrame:
    """The first 400 unique addresses of each run, numbered; the limit is the stage's own."""
    u = D.limit_per_query(stage1_uniques(spark, d), "run_id", [F.col("seq")])
    return D.number_candidates(u, "run_id", [F.col("seq")]).select("run_id", "seq", "cid")


@query(
    f"""WITH {_RANKED_HITS}, c AS (SELECT run_id, count(*) AS incoming, count(*) FILTER (n = 1) AS distinct_urls FROM r GROUP BY run_id)
    SELECT run_id, incoming, least(distinct_urls, 400) AS unique_urls, incoming - least(distinct_urls, 400) AS collapsed FROM c"""
)
def stage1_counts(spark: SparkSession, d: str) -> DataFrame:
    per_url = _clean_hits(spark, d).groupBy("run_id", "canon").agg(F.count("*").alias("n"))
    c = per_url.groupBy("run_id").agg(F.sum("n").alias("incoming"), F.least(F.count("*"), F.lit(400)).alias("unique_urls"))
    return c.withColumn("collapsed", F.col("incoming") - F.col("unique_urls"))


@query(
    """SELECT sha256, count(*) AS copies, arg_min(cid, cid) AS cid, arg_min(engine, cid) AS engine FROM candidates
    WHERE error IS NULL AND sha256 IS NOT NULL AND sha256 <> '' GROUP BY sha256"""
)
def content_unique(spark: SparkSession, d: str) -> DataFrame:
    return D.content_groups(table(spark, d, "candidates").where("error IS NULL"), "sha256", "cid", ["cid", "engine"])


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))


@query(
    """WITH ok AS (SELECT * FROM candidates WHERE error IS NULL AND sha256 IS NOT NULL AND sha256 <> '')
    SELECT count(*) AS downloaded, count(*) FILTER (error IS NOT NULL) AS failed, (SELECT count(*) FROM (SELECT sha256 FROM ok GROUP BY 1 HAVING count(*) > 1)) AS identical_byte_groups,
    (SELECT count(DISTINCT sha256) FROM ok) AS content_unique FROM candidates"""
)
def stage2_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    groups = D.content_groups(c.where("error IS NULL"), "sha256", "cid", ["cid"])
    sums = groups.agg(F.count_if(F.col("copies") > 1).alias("identical_byte_groups"), F.count("*").alias("content_unique"))
    return c.agg(F.count("*").alias("downloaded"), F.count_if(F.col("error").isNotNull()).alias("failed")).crossJoin(F.broadcast(sums))


# ---- stage 3: the filter -------------------------------------------------------------------------

_SCORED = f"""{_PRINTS}, r AS (SELECT run_id, cid, error, luma_mean, ahash, dhash, phash, whash,
      ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL AS ok FROM prints),
    o AS (SELECT run_id, min(cid) AS cid FROM r WHERE ok GROUP BY run_id),
    scored AS (SELECT b.run_id, b.cid, b.ok, b.error, CASE WHEN b.ok THEN round(0.45*(1 - {_HAM["phash"]}/64.0::DOUBLE) + 0.25*(1 - {_HAM["dhash"]}/64.0::DOUBLE)
      + 0.20*(1 - {_HAM["whash"]}/64.0::DOUBLE) + 0.10*(1 - {_HAM["ahash"]}/64.0::DOUBLE), 9) END AS fused,
      CASE WHEN b.ok THEN round(1 - abs(a.luma_mean - b.luma_mean) / 255.0::DOUBLE, 6) END AS color
      FROM o JOIN r a ON a.cid = o.cid JOIN r b ON b.run_id = o.run_id)"""
_FILTERED = f"""{_SCORED}, g AS (SELECT *, coalesce(ok AND (fused >= 0.72 OR (color >= 0.80 AND fused >= 0.55)), false) AS gate FROM scored),
    w AS (SELECT *, row_number() OVER q AS rk, sum(gate::INT) OVER (q ROWS UNBOUNDED PRECEDING) AS grk, sum(gate::INT) OVER (PARTITION BY run_id, ok) AS ng FROM g
      WINDOW q AS (PARTITION BY run_id, ok ORDER BY fused DESC, color DESC, cid)),
    d AS (SELECT *, ok AND gate AND grk <= 60 AS by_gate, ok AND NOT gate AND rk <= 24 AND least(ng, 60) + rk - grk <= 60 AS by_net FROM w)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates scored against the original of their run; the closeness of brightness stands for colour."""
    rows = _prints(spark, d).select("run_id", "cid", "error", "luma_mean", *H.ORDER)
    rows = rows.withColumn("ok", F.expr("ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL"))
    original = rows.where("ok").groupBy("run_id").agg(F.min_by(F.struct("luma_mean", *H.ORDER), "cid").alias("o"))
    got = H.compare({h: F.col("o")[h] for h in H.ORDER}, {h: F.col(h) for h in H.ORDER})
    return rows.join(original, "run_id").select(
        "run_id",
        "cid",
        "ok",
        "error",
        F.when(F.col("ok"), F.round(got["fused"], 9)).alias("fused"),
        F.when(F.col("ok"), F.round(1 - F.abs(F.col("o.luma_mean") - F.col("luma_mean")) / 255.0, 6)).alias("color"),
    )


@query(f"WITH {_FILTERED} SELECT run_id, cid, CASE WHEN ok THEN rk END AS rank, by_gate OR by_net AS kept, gate OR by_net AS decided FROM d")
def stage3_decisions(spark: SparkSession, d: str) -> DataFrame:
    return filtering.filter_candidates(_scored(spark, d), "run_id", "cid").select("run_id", "cid", F.col("rank").cast("bigint").alias("rank"), "kept", "decided")


@query(
    f"""WITH {_FILTERED} SELECT run_id, CASE WHEN NOT ok THEN coalesce(nullif(error, ''), 'undecodable') WHEN by_net THEN 'kept by top-24 safety net'
      WHEN fused >= 0.72 THEN 'hash similarity above threshold' WHEN gate THEN 'colour-palette rescue (possible crop)' ELSE 'below' END AS reason, count(*) AS n FROM d GROUP BY ALL"""
)
def stage3_reasons(spark: SparkSession, d: str) -> DataFrame:
    f = filtering.filter_candidates(_scored(spark, d), "run_id", "cid")
    return f.withColumn("reason", F.when(F.col("reason").startswith("hash similarity 0."), "below").otherwise(F.col("reason"))).groupBy("run_id", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_FILTERED} SELECT run_id, count(*) AS considered, count(*) FILTER (by_gate OR by_net) AS promoted, count(*) FILTER (NOT (by_gate OR by_net)) AS rejected FROM d WHERE ok GROUP BY run_id")
def stage3_counts(spark: SparkSession, d: str) -> DataFrame:
    f = filtering.filter_candidates(_scored(spark, d), "run_id", "cid").where("ok")
    return f.groupBy("run_id").agg(F.count("*").alias("considered"), F.count_if("kept").alias("promoted"), F.count_if(~F.col("kept")).alias("rejected"))


@query(f"WITH {_FILTERED} SELECT c.cid FROM candidates c WHERE c.error IS NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.cid = c.cid AND (by_gate OR by_net))")
def stage3_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that don't go on: an anti join."""
    kept = filtering.filter_candidates(_scored(spark, d), "run_id", "cid").where("kept")
    return table(spark, d, "candidates").where("error IS NULL").select("cid").join(kept.select("cid"), "cid", "left_anti")


# ---- search: engines ----------------------------------------------------------------------------


@query("SELECT e.engine, e.display_name, count(h.engine) AS count FROM engines e LEFT JOIN hits h ON h.engine = e.engine GROUP BY ALL")
def engine_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return report.engine_outcomes(table(spark, d, "hits"), table(spark, d, "engines"))


@query(
    """SELECT 'named' AS asked, engine FROM engines WHERE available AND engine IN ('yarrow', 'mothlight', 'nobody')
    UNION ALL SELECT 'unknown', engine FROM engines WHERE available UNION ALL SELECT 'none', engine FROM engines WHERE available"""
)
def engine_selection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "engines")
    asked = {"named": ["yarrow", "mothlight", "nobody"], "unknown": ["mothlight", "nobody"], "none": []}
    return report.union_sources([report.select_engines(e, names).select(F.lit(k).alias("asked"), "engine") for k, names in asked.items()])


@query("SELECT engine, count(*) AS hits, count(DISTINCT run_id) AS runs FROM hits WHERE engine IN (SELECT engine FROM engines WHERE available) GROUP BY engine")
def search_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Union of the hits of each selected engine, then their outcome."""
    hits, engines = table(spark, d, "hits"), table(spark, d, "engines")
    names = [r["engine"] for r in report.select_engines(engines, None).collect()]
    union = report.union_sources([hits.where(F.col("engine") == n).select("engine", "run_id", "seq") for n in names])
    return union.groupBy("engine").agg(F.count("*").alias("hits"), F.count_distinct("run_id").alias("runs"))


# ---- merging ------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT DISTINCT label, representative_cid AS cid, confidence FROM cards WHERE representative_cid <> '' AND label IN (SELECT label FROM label_groups WHERE is_one_to_one))
    SELECT a.label, a.cid AS cid_a, b.cid AS cid_b, count(*) AS pairs FROM v a JOIN v b ON a.label = b.label AND a.cid < b.cid AND abs(a.confidence - b.confidence) <= 0.5 GROUP BY ALL"""
)
def pairs_within_label(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near confidence within each 1:1 label."""
    ones = table(spark, d, "label_groups").where("is_one_to_one").select("label")
    v = table(spark, d, "cards").where("representative_cid <> ''").join(F.broadcast(ones), "label", "left_semi").select("label", F.col("representative_cid").alias("cid"), "confidence").distinct()
    p = merge.band_pairs(v, ["label"], "confidence", "cid", 0.5).where("abs(value_a - value_b) <= 0.5")
    return p.groupBy("label", "cid_a", "cid_b").agg(F.count("*").alias("pairs"))


@query(
    """WITH v AS (SELECT DISTINCT run_id, card_key AS cid, overlap FROM cards WHERE label = 'CROP' AND overlap IS NOT NULL)
    SELECT a.run_id, a.cid AS cid_a, b.cid AS cid_b, a.overlap AS value_a, b.overlap AS value_b FROM v a JOIN v b
    ON a.run_id = b.run_id AND a.cid < b.cid AND round(abs(a.overlap - b.overlap), 9) <= 0.05"""
)
def crop_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "cards").where("label = 'CROP' AND overlap IS NOT NULL").select("run_id", F.col("card_key").alias("cid"), "overlap").distinct()
    return merge.band_pairs(v, ["run_id"], "overlap", "cid")


_EDGES = """edges AS (SELECT cid_a AS a, cid_b AS b FROM match_pairs WHERE is_match AND identity_score >= 0.92 AND changed_fraction <= 0.04 AND len(edit_labels) = 0 AND cid_a <> cid_b),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk(root, cid) AS (SELECT a, a FROM both_ways UNION SELECT w.root, e.b FROM walk w JOIN both_ways e ON w.cid = e.a WHERE e.b > w.root),
    comp AS (SELECT cid, min(root) AS cluster FROM walk GROUP BY cid),
    members AS (SELECT c.*, coalesce(k.cluster, c.cid) AS cluster FROM candidates c LEFT JOIN comp k USING (cid) WHERE c.error IS NULL)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("error IS NULL")
    p = table(spark, d, "match_pairs").where(F.col("is_match") & merge.same_picture(F.col("identity_score"), F.col("changed_fraction"), F.col("edit_labels")))
    return c.join(merge.clusters(c, p.select("cid_a", "cid_b")), "cid")


@query(f"WITH RECURSIVE {_EDGES} SELECT cid, cluster FROM members")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("cid", "cluster")


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS members,
      row_number() OVER (PARTITION BY cluster ORDER BY coalesce(width::BIGINT * height, 0) DESC, cid) AS n FROM members)
    SELECT cluster, cid, url, width, height, members FROM r WHERE n = 1"""
)
def cluster_representative(spark: SparkSession, d: str) -> DataFrame:
    return merge.representative(_members(spark, d), ["cluster"], "cid")


@query(
    f"""WITH RECURSIVE {_EDGES}, x AS (SELECT cluster, page_url AS v, min(cid) AS c FROM members WHERE page_url <> '' GROUP BY ALL),
    y AS (SELECT cluster, engine AS v, min(cid) AS c FROM members WHERE engine <> '' GROUP BY ALL)
    SELECT m.cluster, coalesce((SELECT string_agg(v, '|' ORDER BY c, v) FROM x WHERE x.cluster = m.cluster), '') AS pages,
      coalesce((SELECT string_agg(v, '|' ORDER BY c, v) FROM y WHERE y.cluster = m.cluster), '') AS engines FROM (SELECT DISTINCT cluster FROM members) m"""
)
def cluster_sources(spark: SparkSession, d: str) -> DataFrame:
    g = _members(spark, d).groupBy("cluster")
    return g.agg(F.array_join(merge.ordered_distinct("page_url", "cid"), "|").alias("pages"), F.array_join(merge.ordered_distinct("engine", "cid"), "|").alias("engines"))


@query(
    """SELECT r.cid AS rep_cid, m.cid AS member_cid FROM (SELECT DISTINCT representative_cid AS cid FROM cards WHERE representative_cid <> '') k
    JOIN candidates r ON r.cid = k.cid JOIN candidates m ON m.sha256 = r.sha256 WHERE r.sha256 <> ''"""
)
def sha_members(spark: SparkSession, d: str) -> DataFrame:
    """All byte-identical members of each representative."""
    c = table(spark, d, "candidates").where("sha256 <> ''").select("cid", "sha256")
    reps = table(spark, d, "cards").where("representative_cid <> ''").select(F.col("representative_cid").alias("cid")).distinct()
    own = reps.join(c, "cid").select(F.col("cid").alias("rep_cid"), "sha256")
    return merge.same_bytes(own, c.withColumnRenamed("cid", "member_cid"), "sha256", F.col("member_cid")).drop("sha256")


@query(
    f"""WITH h AS (SELECT DISTINCT seq, {CANON} AS canon FROM hits WHERE url IS NOT NULL),
    k AS (SELECT {CANON.replace("(url,", "(best_url,")} AS canon, max(card_key) AS card_key FROM cards WHERE best_url <> '' GROUP BY 1)
    SELECT seq, card_key FROM h JOIN k USING (canon)"""
)
def alias_attach(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose address a card shows; the last card of several."""
    cards = table(spark, d, "cards").where("best_url <> ''").select("card_key", U.canonical_url(F.col("best_url")).alias("canon"))
    hits = table(spark, d, "hits").where("url IS NOT NULL").select("seq", "url").distinct()
    return merge.attach_aliases(cards, hits, U.canonical_url(F.col("url")), F.col("card_key")).select("seq", "card_key").distinct()


# ---- report -------------------------------------------------------------------------------------

_CARDS = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_key ORDER BY merged_at DESC, array_to_string(member_cids, ',')) AS n FROM cards) WHERE n = 1)"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each card."""
    c = table(spark, d, "cards")
    return D.first_per_key(c, [F.col("card_key")], [-F.unix_micros(F.col("merged_at").cast("timestamp")), F.array_join("member_cids", ",")])


@query(
    f"""WITH {_CARDS} SELECT count(*) AS merged_cards, count(*) FILTER (label IN ('EXACT_1TO1','NEAR_1TO1','EDITED_1TO1')) AS one_to_one, count(*) FILTER (label = 'CROP') AS crops,
    count(*) FILTER (label = 'VISUALLY_SIMILAR') AS similar, count(*) FILTER (label IN ('UNRELATED','ERROR')) AS unrelated FROM k"""
)
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.card_counts(_cards(spark, d))


@query(
    f"""WITH {_CARDS}, dim AS (SELECT DISTINCT group_name, group_rank, title FROM label_groups)
    SELECT k.group_name, coalesce(group_rank, 99) AS group_rank, title, count(*) AS cards, max(confidence) AS best_confidence FROM k LEFT JOIN dim USING (group_name) GROUP BY ALL"""
)
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    return report.report_groups(_cards(spark, d), table(spark, d, "label_groups"))


@query(
    f"""WITH {_CARDS} SELECT run_id, card_key, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(group_rank, 99), confidence DESC, card_key) AS position
    FROM k LEFT JOIN label_groups USING (label)"""
)
def report_order(spark: SparkSession, d: str) -> DataFrame:
    k = _cards(spark, d).join(F.broadcast(table(spark, d, "label_groups").select("label", "group_rank")), "label", "left")
    return report.report_positions(k, "run_id").select("run_id", "card_key", "position")


@query(
    """WITH p AS (SELECT DISTINCT least(cid_a, cid_b) || ' ' || greatest(cid_a, cid_b) || ' ' || compared_at AS pair, is_match, identity_score >= 0.92 AND changed_fraction <= 0.04 AND len(edit_labels) = 0 AS same
      FROM match_pairs WHERE cid_a IS NOT NULL AND cid_b IS NOT NULL AND compared_at IS NOT NULL)
    SELECT coalesce(CAST(is_match AS VARCHAR), 'failed') AS expected, coalesce(CAST(same AS VARCHAR), 'failed') AS actual, count(*) AS n FROM p GROUP BY ALL"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The decision a pair came with against the one its measurements give."""
    p = table(spark, d, "match_pairs").where("cid_a IS NOT NULL AND cid_b IS NOT NULL AND compared_at IS NOT NULL")
    same = merge.same_picture(F.col("identity_score"), F.col("changed_fraction"), F.col("edit_labels"))
    pair = F.concat_ws(" ", F.least("cid_a", "cid_b"), F.greatest("cid_a", "cid_b"), F.col("compared_at").cast("string"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("failed"))
    rows = p.select(pair.alias("pair"), F.struct(named(F.col("is_match")).alias("e"), named(same).alias("a")).alias("x"), F.xxhash64("is_match", same).alias("h")).distinct()
    rows = rows.withColumn("pair", F.struct("pair", "h"))
    return report.confusion(rows.select("pair", F.col("x.a").alias("actual")), rows.select("pair", F.col("x.e").alias("expected")), "pair")


@query(
    f"""WITH {_CARDS}, dim AS (SELECT DISTINCT group_name, group_rank, title FROM label_groups)
    SELECT run_id, k.group_name, coalesce(group_rank, 99) AS group_rank, title, card_key, row_number() OVER (PARTITION BY run_id, k.group_name ORDER BY confidence DESC, card_key) AS place
    FROM k LEFT JOIN dim USING (group_name)"""
)
def report_listing(spark: SparkSession, d: str) -> DataFrame:
    """The cards that each group of a run's report lists, in order."""
    return report.cards_by_group(_cards(spark, d), table(spark, d, "label_groups")).select("run_id", "group_name", "group_rank", "title", "card_key", "place")


@query(
    f"""WITH {_CARDS} SELECT coalesce(label, 'total') AS label, count(*) AS cards, round(avg(confidence), 6) AS mean_confidence,
    count(*) FILTER (confidence >= 85) AS confident FROM k GROUP BY GROUPING SETS ((label), ())"""
)
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and share by label with a grand total, by grouping sets."""
    k = _cards(spark, d)
    agg = [F.count("*").alias("cards"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") >= 85).alias("confident")]
    return k.rollup("label").agg(*agg).withColumn("label", F.coalesce("label", F.lit("total")))


_HOST = r"lower(regexp_extract(trim(x), '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(
    f"""WITH {_CARDS}, h AS (SELECT card_key, list_filter(list_transform(pages, lambda x: {_HOST}), lambda x: x <> '') AS hosts, pages, engines FROM k)
    SELECT card_key, array_to_string(hosts[1:4], '|') AS shown_hosts, greatest(len(hosts) - 4, 0) AS more_hosts, array_to_string(engines[1:3], '|') AS shown_engines, greatest(len(engines) - 3, 0) AS more_engines,
    len(pages) AS pages FROM h"""
)
def card_headlines(spark: SparkSession, d: str) -> DataFrame:
    """What a card shows: the hosts of four pages, three engines, how many more there are, and the number of its pages."""
    k = report.card_headline(_cards(spark, d))
    return k.select("card_key", F.array_join("shown_hosts", "|").alias("shown_hosts"), "more_hosts", F.array_join("shown_engines", "|").alias("shown_engines"), "more_engines", F.size("pages").cast("bigint").alias("pages"))


@query(
    f"""WITH {_CARDS} SELECT k.card_key, k.label, k.display, k.group_name, g.group_rank, round_even(k.confidence / 7.0123::DOUBLE, 1) AS confidence, round_even(k.overlap / 7.0123::DOUBLE, 4) AS overlap, k.representative_cid, k.best_url, k.best_width, k.best_height,
      array_to_string(k.member_cids, '|') AS member_cids, array_to_string(k.pages, '|') AS pages, array_to_string(k.engines, '|') AS engines,
      round_even(c.luma_mean / 7.0123::DOUBLE, 2) AS luma_mean, c.download_ms, c.stage_reached, c.error
    FROM k LEFT JOIN label_groups g USING (label) LEFT JOIN candidates c ON c.cid = k.representative_cid"""
)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their representative as report JSON, a text a card, and read back; each number over 7.0123, so that there is
    something to round."""
    k = _cards(spark, d).join(F.broadcast(table(spark, d, "label_groups").select("label", "group_rank")), "label", "left")
    c = table(spark, d, "candidates").select(F.col("cid").alias("representative_cid"), "luma_mean", "download_ms", "stage_reached", "error")
    rows = k.join(c, "representative_cid", "left").withColumns({x: F.col(x) / 7.0123 for x in ("confidence", "overlap", "luma_mean")})
    return report.from_report_json(report.to_report_json(rows).select("j"), "j").withColumns({x: F.array_join(x, "|") for x in ("member_cids", "pages", "engines")})


# ---- statistics -----------------------------------------------------------------------------------


@query(
    """SELECT engine, count(*) AS n, round(median(luma_mean), 6) AS median_luma, round(quantile_cont(download_ms, 0.95), 6) AS p95_ms,
    round(covar_samp(luma_mean, luma_std), 6) AS covariance, round(stddev_pop(luma_std), 6) AS spread, round(var_pop(luma_mean), 6) AS variance FROM candidates GROUP BY engine"""
)
def candidate_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, interpolated percentile, covariance and spread by engine; the ranked ones by steps, as an engine may hold a
    large share of all rows."""
    c = table(spark, d, "candidates")
    plain = c.groupBy("engine").agg(
        F.count("*").alias("n"),
        F.round(F.covar_samp("luma_mean", "luma_std"), 6).alias("covariance"),
        F.round(F.stddev_pop("luma_std"), 6).alias("spread"),
        F.round(F.var_pop("luma_mean"), 6).alias("variance"),
    )
    luma = ranking.percentiles(c, "engine", "luma_mean", {"median_luma": 0.5}, F.floor(F.col("luma_mean") * 8))
    slow = ranking.percentiles(c, "engine", "download_ms", {"p95_ms": 0.95}, F.floor(F.col("download_ms") / 8))
    out = plain.join(luma, "engine", "left").join(slow, "engine", "left")
    return out.withColumns({k: F.round(k, 6) for k in ("median_luma", "p95_ms")})


@query(f"WITH {_PRINTS} SELECT cid, error IS NULL AND sha256 IS NOT NULL AND ahash IS NOT NULL AND dhash IS NOT NULL AND phash IS NOT NULL AND whash IS NOT NULL AS ok FROM prints")
def ok_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a candidate has an image and all four fingerprints (P5)."""
    return _prints(spark, d).select("cid", filtering.usable(F.col("error"), F.col("sha256"), [F.col(h) for h in H.ORDER]).alias("ok"))


@query("SELECT e.engine, row_number() OVER (ORDER BY e.engine) AS position FROM engines e WHERE engine IN (SELECT engine FROM hits)")
def engine_order(spark: SparkSession, d: str) -> DataFrame:
    """Engines that returned hits (a semi join), by name."""
    from pyspark.sql.window import Window

    found = table(spark, d, "engines").join(table(spark, d, "hits").select("engine"), "engine", "left_semi")
    return found.select("engine", F.row_number().over(Window.orderBy("engine")).cast("bigint").alias("position"))


@query(
    """WITH s AS (SELECT engine, count(*) AS hits, count(DISTINCT run_id) AS runs FROM hits GROUP BY engine UNION ALL SELECT engine, 0, 0 FROM engines)
    SELECT engine, CAST(sum(hits) AS BIGINT) AS hits, max(runs) AS runs FROM s GROUP BY engine"""
)
def engine_totals(spark: SparkSession, d: str) -> DataFrame:
    """Outcome rows of all engines by union."""
    h = table(spark, d, "hits").groupBy("engine").agg(F.count("*").alias("hits"), F.count_distinct("run_id").alias("runs"))
    e = table(spark, d, "engines").select("engine", F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("runs"))
    return report.union_sources([h, e]).groupBy("engine").agg(F.sum("hits").alias("hits"), F.max("runs").alias("runs"))
