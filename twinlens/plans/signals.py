"""Queries for fused signals, coverage and verdicts over signals derived from lineitem keys.

The tables hold no measured image signals, so each row of lineitem is given some by whole-number
arithmetic on its keys; all branches of the verdict occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import config
from twinlens.functions import geometry as G
from twinlens.functions import signals as S
from twinlens.operators import classify, filtering
from twinlens.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _unit(a: int, b: int, c: int, m: int = 1000) -> str:
    return f"CAST((k * {a} + n * {b} + {c}) % {m + 1} AS DOUBLE) / {m}"


# Plain SQL that both engines read alike: k, n are the keys, base a common quality, s1..s7 noise.
_KEYS = "(SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)"
_NOISE = f"(SELECT k, n, {_unit(7919, 104729, 13)} AS base, " + ", ".join(f"({_unit(7919 + 12 * i, 1299709 + 8 * i, 17 * i)} - 0.5) * 0.3 AS s{i}" for i in range(1, 8)) + f" FROM {_KEYS})"
_SIGNALS = f"""(SELECT k, n, base + s1 AS hash_sim, base + s2 AS ssim, base + s3 AS nrmse_sim, base + s4 AS grad_corr, base + s5 AS emb_cos, base + s6 AS feat_sim, base + s7 AS hist_corr,
  CASE WHEN k % 3 = 0 THEN CAST((k * 31 + n * 7) % 9 AS DOUBLE) / 100 ELSE CAST((k * 31 + n * 7) % 101 AS DOUBLE) / 100 END AS changed_fraction,
  CASE WHEN n % 2 = 0 THEN CAST(90 + (k * 13 + n) % 11 AS DOUBLE) / 100 ELSE CAST((k * 13 + n * 17) % 101 AS DOUBLE) / 100 END AS coverage_orig,
  CASE WHEN k % 2 = 0 THEN CAST(96 + (k * 29 + n) % 5 AS DOUBLE) / 100 ELSE CAST((k * 29 + n * 11) % 101 AS DOUBLE) / 100 END AS coverage_cand,
  CASE (k + n) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'template' ELSE 'homography' END AS coverage_source,
  CAST((k * 37 + n * 5) % 101 AS DOUBLE) / 100 AS aspect_sim,
  CASE (k * 3 + n) % 11 WHEN 0 THEN 'rot90' WHEN 1 THEN 'mirror-h' ELSE 'identity' END AS orientation,
  (k * 5 + n) % 97 = 0 AS sha_identical,
  CAST((k + n * 3) % 7 AS INT) AS edit_code, CAST((k * 11 + n) % 60 AS INT) AS inliers, CAST((k * 17 + n) % 101 AS DOUBLE) / 100 AS inlier_ratio FROM {_NOISE} AS noise)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql(f"SELECT * FROM {_SIGNALS} AS signals")
    labels = F.when(F.col("edit_code") == 0, F.array(F.lit("brightness"))).when(F.col("edit_code") == 1, F.array(F.lit("recompressed"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("edit_labels", labels)


_W = config.CLASSIFIER.weights
_IDENTITY = " + ".join(f"{w} * greatest(0.0, least(1.0, {k}))" for k, w in _W.items())
_SIG = f"""sig AS (SELECT *, {_IDENTITY} AS identity, CASE WHEN coverage_source = 'none' THEN least(0.95, aspect_sim) ELSE coverage_orig END AS co,
  CASE WHEN coverage_source = 'none' THEN least(0.95, aspect_sim) ELSE coverage_cand END AS cc, changed_fraction <= 0.12 AS clean,
  orientation <> 'identity' OR edit_code = 0 AS material FROM {_SIGNALS} AS t)"""
_VERDICT = f"""{_SIG}, v AS (SELECT *, CASE WHEN sha_identical THEN 'EXACT_1TO1' WHEN co < 0.96 AND cc >= 0.75 AND ssim >= 0.80 AND clean THEN 'CROP'
  WHEN co >= 0.90 AND identity >= 0.84 AND clean THEN CASE WHEN material OR cc < 0.96 THEN 'EDITED_1TO1' WHEN identity >= 0.92 AND changed_fraction <= 0.04 THEN 'EXACT_1TO1' ELSE 'NEAR_1TO1' END
  WHEN identity >= 0.55 AND ssim >= 0.45 THEN 'VISUALLY_SIMILAR' ELSE 'UNRELATED' END AS label FROM sig),
  m AS (SELECT *, CASE WHEN label = 'CROP' THEN 0.5 * least(1.0, ssim / 0.94) + 0.5 * cc WHEN label IN ('EDITED_1TO1', 'NEAR_1TO1') THEN (identity - 0.84) / 0.16
  WHEN label = 'EXACT_1TO1' THEN (identity - 0.92) / 0.08 * 1.2 ELSE (identity - 0.55) / 0.45 END AS margin FROM v),
  c AS (SELECT *, CASE WHEN sha_identical THEN 100.0 ELSE 100.0 / (1.0 + exp(-7.0 * greatest(-1.5, least(1.5, margin)))) END AS confidence FROM m)"""


@query(f"WITH {_SIG} SELECT k, n, round(identity, 9) AS identity, round(CASE WHEN coverage_source = 'none' THEN least(0.9, 0.9 * aspect_sim) ELSE coverage_orig * coverage_cand END, 9) AS frame_agreement FROM sig")
def fuse_identity(spark: SparkSession, d: str) -> DataFrame:
    v = classify.verdict_columns(_signals(spark, d))
    return v.select("k", "n", F.round("identity", 9).alias("identity"), F.round("frame_agreement", 9).alias("frame_agreement"))


@query(f"SELECT k, n, round(CASE WHEN inliers >= 15 THEN least(1.0, inliers / 40.0::DOUBLE) * least(1.0, inlier_ratio / 0.45::DOUBLE) ELSE 0 END, 9) AS feat FROM {_SIGNALS} AS t")
def feature_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    return s.select("k", "n", F.round(S.feature_similarity(F.col("inliers") >= 15, F.col("inliers"), F.col("inlier_ratio")), 9).alias("feat"))


@query(f"WITH {_VERDICT} SELECT k, n, label, round(confidence, 4) AS confidence, round(CASE WHEN label = 'CROP' THEN co END, 9) AS overlap FROM c")
def classify_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = classify.verdict_columns(_signals(spark, d))
    return v.select("k", "n", "label", F.round("confidence", 4).alias("confidence"), F.round("overlap", 9).alias("overlap"))


@query(f"WITH {_VERDICT} SELECT g.group_name, g.group_rank, c.label, count(*) AS pairs FROM c JOIN label_groups g USING (label) GROUP BY ALL")
def verdict_groups(spark: SparkSession, d: str) -> DataFrame:
    v = classify.verdict_columns(_signals(spark, d)).groupBy("label").agg(F.count("*").alias("pairs"))
    dim = table(spark, d, "label_groups").select("label", "group_name", "group_rank")
    return v.join(F.broadcast(dim), "label")


# four digits, halves up
_R4 = "CAST(round(CAST(round({0}, 9) AS DECIMAL(18, 9)), 4) AS DOUBLE)"


def _held(name: str, value: str, bound: float) -> str:
    return f"format('{name} {{:.4f}} ', {_R4.format(value)}) || CASE WHEN {value} >= {bound} THEN '>= {bound:g}' ELSE '< {bound:g}' END"


_ONE = "label IN ('EXACT_1TO1', 'NEAR_1TO1', 'EDITED_1TO1')"
_TURNS = "CASE orientation WHEN 'rot90' THEN 'rotated 90 degrees' WHEN 'mirror-h' THEN 'mirrored horizontally' END"
_FINDINGS = [
    ("sha_identical", "'same bytes'"),
    ("coverage_source = 'none'", "'no geometry, shape compared instead'"),
    ("label = 'CROP'", "'shows a part of the original'"),
    ("partial AND label <> 'CROP'", "'partial view, yet other pixels'"),
    ("label = 'EDITED_1TO1' AND cc < 0.96", "'whole original within a larger picture'"),
    ("NOT sha_identical AND (label = 'CROP' OR partial OR (rejected AND co < 0.9))", _held("original covered", "co", 0.9)),
    ("label IN ('CROP', 'EDITED_1TO1')", _held("candidate covered", "cc", 0.75)),
    (f"(NOT sha_identical AND {_ONE}) OR rejected", _held("identity", "identity", 0.84)),
    ("NOT sha_identical AND label = 'EXACT_1TO1'", _held("identity", "identity", 0.92)),
    ("rejected", _held("identity", "identity", 0.55)),
    ("rejected", _held("structure", "ssim", 0.45)),
    ("label = 'CROP'", _held("structure", "ssim", 0.8)),
    ("NOT sha_identical", "format('changed blocks {:.4f} ', " + _R4.format("changed_fraction") + ") || CASE WHEN clean THEN '<= 0.12' ELSE '> 0.12' END"),
    ("label = 'EDITED_1TO1' AND material", f"'edits: ' || concat_ws(', ', {_TURNS}, CASE WHEN edit_code = 0 THEN 'brightness' END)"),
    ("NOT sha_identical AND label IN ('EXACT_1TO1', 'NEAR_1TO1') AND edit_code <= 1", "'harmless: ' || CASE edit_code WHEN 0 THEN 'brightness' ELSE 'recompressed' END"),
    ("NOT sha_identical AND label IN ('CROP', 'EXACT_1TO1')", "'aligned by ' || coverage_source"),
]


@query(
    f"WITH {_VERDICT} SELECT k, n, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in _FINDINGS)
    + """) AS reasons FROM (SELECT *, NOT sha_identical AND co < 0.96 AND cc >= 0.75 AS partial, label IN ('VISUALLY_SIMILAR', 'UNRELATED') AS rejected FROM c) x"""
)
def verdict_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The findings of each verdict, word for word."""
    v = classify.reasons(classify.verdict_columns(_signals(spark, d).withColumn("align_method", F.col("coverage_source"))))
    return v.select("k", "n", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {_SIG} SELECT identity >= 0.4675 AS promoted, count(*) AS pairs, count(DISTINCT k) AS originals FROM sig GROUP BY 1")
def promoted_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = classify.verdict_columns(_signals(spark, d)).select("k", filtering.promising(F.col("identity")).alias("promoted"))
    return v.groupBy("promoted").agg(F.count("*").alias("pairs"), F.count_distinct("k").alias("originals"))


@query(
    f"""SELECT k, n, CASE orientation WHEN 'rot90' THEN 'rotated 90 degrees' WHEN 'mirror-h' THEN 'mirrored horizontally' ELSE orientation END AS orientation FROM {_SIGNALS} AS t"""
)
def orientation_label(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("k", "n", classify.orientation_label(F.col("orientation")).alias("orientation"))


@query("SELECT cid, 'ERROR' AS label, 0.0::DOUBLE AS confidence, error AS reason FROM candidates WHERE error <> ''")
def error_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("error <> ''").select("cid", "error")
    return classify.error_verdict(c, F.col("error")).select("cid", "label", "confidence", F.col("reasons")[0].alias("reason"))


_FLAGS = ["border", "watermark", "brightness", "contrast", "colour", "blur", "sharpen", "recompressed"]


@query(
    """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) * 5 + l_linenumber AS c FROM lineitem),
    x AS (SELECT k, n, concat_ws(', ', CASE WHEN c % 2 = 0 THEN 'border' END, CASE WHEN c // 2 % 2 = 0 THEN 'watermark/text overlay' END, CASE WHEN c // 4 % 2 = 0 THEN 'brightness' END,
      CASE WHEN c // 8 % 2 = 0 THEN 'contrast' END, CASE WHEN c // 16 % 2 = 0 THEN 'colour' END, CASE WHEN c // 32 % 2 = 0 THEN 'blur' END, CASE WHEN c // 64 % 2 = 0 THEN 'sharpen' END) AS e, c // 128 % 2 = 0 AS r FROM f)
    SELECT k, n, CASE WHEN e <> '' THEN e WHEN r THEN 'recompressed' ELSE '' END AS edits FROM x"""
)
def edit_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.expr("cast(l_quantity as bigint) * 5 + l_linenumber").alias("c"))
    flags = {name: F.expr(f"c div {1 << i} % 2 = 0") for i, name in enumerate(_FLAGS)}
    return c.select("k", "n", F.array_join(classify.edit_labels(flags), ", ").alias("edits"))


# ---- sizes and coverage -----------------------------------------------------------------------------

_SIZES = "(SELECT cid, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, width, height FROM candidates WHERE width > 0 AND height > 0)"


@query(
    f"""SELECT cid, round(least(w / h, 1.5::DOUBLE) / greatest(w / h, 1.5::DOUBLE), 9) AS similarity, round(1 - least(w, h) / greatest(w, h), 9) AS gap,
    CASE WHEN greatest(w, h) <= 512 THEN width ELSE greatest(1, CAST(round_even(w * 512 / greatest(w, h), 0) AS INT)) END AS fit_w,
    CASE WHEN greatest(w, h) <= 512 THEN height ELSE greatest(1, CAST(round_even(h * 512 / greatest(w, h), 0) AS INT)) END AS fit_h FROM {_SIZES} s"""
)
def fit_and_aspect(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("width > 0 AND height > 0").withColumns({"w": F.col("width").cast("double"), "h": F.col("height").cast("double")})
    fw, fh = G.fit_size(F.col("w"), F.col("h"), 512)
    return c.select(
        "cid",
        F.round(G.aspect_similarity(F.col("w") / F.col("h"), F.lit(1.5)), 9).alias("similarity"),
        F.round(G.aspect_gap(F.col("w"), F.col("h")), 9).alias("gap"),
        fw.alias("fit_w"),
        fh.alias("fit_h"),
    )


_BOX = """(SELECT p_partkey AS k, CAST(p_partkey % 40 - 10 AS DOUBLE) AS x0, CAST(p_partkey % 30 - 5 AS DOUBLE) AS y0, CAST(p_partkey % 40 - 10 + p_size * 3 AS DOUBLE) AS x1,
  CAST(p_partkey % 30 - 5 + p_size * 2 AS DOUBLE) AS y1, CAST(60 + p_partkey % 41 AS DOUBLE) AS w, CAST(50 + p_partkey % 31 AS DOUBLE) AS h FROM part)"""
_INSIDE = "greatest(0, least(x1, w) - greatest(x0, 0)) * greatest(0, least(y1, h) - greatest(y0, 0))"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT * FROM {_BOX} AS box")


@query(f"""SELECT k, round({_INSIDE} / ((x1 - x0) * (y1 - y0)), 9) AS box_orig, round({_INSIDE} / (w * h), 9) AS box_cand, round({_INSIDE} / (w * h), 9) AS crop_orig FROM {_BOX} b""")
def coverage_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    args = [F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")]
    o, c = G.coverage_of_box(*args)
    return b.select("k", F.round(o, 9).alias("box_orig"), F.round(c, 9).alias("box_cand"), F.round(G.coverage_of_crop(*args)[0], 9).alias("crop_orig"))


@query(
    f"""WITH c AS (SELECT k, n, CASE WHEN k % 4 <> 0 THEN coverage_orig END AS fo, CASE WHEN k % 4 <> 0 THEN coverage_cand END AS fc, CASE WHEN n % 3 <> 0 THEN aspect_sim END AS t, CASE WHEN n % 3 <> 0 THEN inlier_ratio END AS tc FROM {_SIGNALS} AS s)
    SELECT k, n, CASE WHEN fo IS NOT NULL AND t IS NOT NULL AND abs(fo - t) > 0.15 THEN least(fo, t) ELSE coalesce(fo, t, 0) END AS cov,
    CASE WHEN fo IS NOT NULL AND t IS NOT NULL AND abs(fo - t) > 0.15 THEN CASE WHEN fo <= t THEN fc ELSE tc END WHEN fo IS NOT NULL THEN fc ELSE coalesce(tc, 0) END AS cand,
    CASE WHEN fo IS NOT NULL AND t IS NOT NULL AND abs(fo - t) > 0.15 THEN 'conservative-agreement' WHEN fo IS NOT NULL THEN 'homography' WHEN t IS NOT NULL THEN 'template' ELSE 'none' END AS source FROM c"""
)
def merge_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    f, t = F.col("k") % 4 != 0, F.col("n") % 3 != 0
    cov, cand, source = G.merge_coverage(F.when(f, F.col("coverage_orig")), F.when(f, F.col("coverage_cand")), F.when(t, F.col("aspect_sim")), F.when(t, F.col("inlier_ratio")))
    return s.select("k", "n", cov.alias("cov"), cand.alias("cand"), source.alias("source"))


@query(f"SELECT k, round(abs((x0*y0 - x1*y0) + (x1*y1 - x1*y0) + (x1*(y1+h) - (x1+w)*y1) + ((x1+w)*y0 - x0*(y1+h))) / 2, 6) AS area FROM {_BOX} b")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    p = F.array(
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")),
        F.struct(F.col("x1").alias("x"), F.col("y0").alias("y")),
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct((F.col("x1") + F.col("w")).alias("x"), (F.col("y1") + F.col("h")).alias("y")),
    )
    return b.select("k", F.round(G.polygon_area(p), 6).alias("area"))


# A third of the parts each: a scaling, a quarter turn, and a perspective whose picture lies wholly inside a large candidate.
_MOVE = """(SELECT k, k % 3 AS kind, 0.5 + CAST(k % 7 AS DOUBLE) / 4 AS s, CASE WHEN k % 3 = 2 THEN abs(x0) ELSE x0 END AS x0, CASE WHEN k % 3 = 2 THEN abs(y0) ELSE y0 END AS y0, w, h, CASE WHEN k % 3 = 2 THEN w * 40 ELSE w * 1.25 END AS cw, CASE WHEN k % 3 = 2 THEN h * 40 ELSE h * 0.75 END AS ch,
  CAST(k % 5 AS DOUBLE) / 10 AS px, CAST(k % 4 AS DOUBLE) / 10 AS py FROM {} b)""".format(_BOX)
# left, top, width and height of the original's image: as it is, or on its side with its right edge at x0 + h
_PLACED = f"""(SELECT *, CASE kind WHEN 1 THEN x0 + h - s * h ELSE x0 END AS l, y0 AS t, CASE kind WHEN 1 THEN s * h ELSE s * w END AS iw, CASE kind WHEN 1 THEN s * w ELSE s * h END AS ih FROM {_MOVE} m)"""
_HIT = "greatest(0, least(l + iw, cw) - greatest(l, 0)) * greatest(0, least(t + ih, ch) - greatest(t, 0))"
# the perspective's corners have the divisors 1, 1 + px, 1 + px + py, 1 + py


@query(
    f"""WITH q AS (SELECT *, (s * w + x0) / (1 + px) AS sx2, y0 / (1 + px) AS sy2, (s * w + x0) / (1 + px + py) AS sx3, (s * h + y0) / (1 + px + py) AS sy3, x0 / (1 + py) AS sx4, (s * h + y0) / (1 + py) AS sy4 FROM {_PLACED} p),
    a AS (SELECT *, abs((x0 * sy2 - sx2 * y0) + (sx2 * sy3 - sx3 * sy2) + (sx3 * sy4 - sx4 * sy3) + (sx4 * y0 - x0 * sy4)) / 2 AS bent FROM q)
    SELECT k, CASE kind WHEN 2 THEN 1.0 ELSE round({_HIT} / (iw * ih), 6) END AS original, CAST(round(CAST(CASE kind WHEN 2 THEN bent ELSE {_HIT} END / (cw * ch) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS candidate,
    round(CASE kind WHEN 2 THEN sqrt(bent / (w * h)) ELSE s END, 6) AS scale FROM a"""
)
def coverage_transform(spark: SparkSession, d: str) -> DataFrame:
    """Corners through a transform, cut by the candidate's frame: scalings, quarter turns and perspectives."""
    import numpy as np
    import pandas as pd

    from twinlens.kernels.geometry import coverages

    table(spark, d, "part").createOrReplaceTempView("part")

    def run(parts):
        for p in parts:
            n, kind = len(p), p["kind"].to_numpy()
            s, x0, y0, w, h, px, py = (p[c].to_numpy(dtype=float) for c in ("s", "x0", "y0", "w", "h", "px", "py"))
            m = np.zeros((n, 3, 3))
            m[:, 0, 0] = np.where(kind == 1, 0, s)
            m[:, 0, 1] = np.where(kind == 1, -s, 0)
            m[:, 1, 0] = np.where(kind == 1, s, 0)
            m[:, 1, 1] = np.where(kind == 1, 0, s)
            m[:, 0, 2], m[:, 1, 2] = np.where(kind == 1, x0 + h, x0), y0
            m[:, 2] = np.stack((np.where(kind == 2, px / w, 0), np.where(kind == 2, py / h, 0), np.ones(n)), axis=1)
            c = coverages(m, np.stack((w, h), axis=1), p[["cw", "ch"]].to_numpy(dtype=float))
            yield pd.DataFrame({"k": p["k"], "original": c["original"], "candidate": c["candidate"], "scale": c["scale"]})

    got = spark.sql(f"SELECT * FROM {_MOVE} AS m").mapInPandas(run, "k bigint, original double, candidate double, scale double")
    return got.select("k", *(F.round(F.round(c, 10), 6).alias(c) for c in ("original", "candidate", "scale")))
