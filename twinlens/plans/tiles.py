"""Queries over the 64-number vectors of embeddings, read as 8 x 8 luma tiles, and over descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.functions import hashes as H
from twinlens.functions import tiles as T
from twinlens.functions import vectors as V
from twinlens.operators.ranking import spread_rank
from twinlens.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TILES = "tiles AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _bits(test: str) -> str:
    return f"array_to_string(list_transform(v, lambda x: CASE WHEN x {test} THEN '1' ELSE '0' END), '')"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_SUM = "list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, b: a + b)"


@query(f"WITH {_TILES}, m AS (SELECT vec_id, v, {_SUM} / 64 AS mu FROM tiles) SELECT vec_id, {_bits('>= mu')} AS bits FROM m")
def ahash_bits(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", T.average_bits(F.col("v")).alias("bits"))


@query(f"WITH {_TILES}, m AS (SELECT vec_id, v, list_median(v) AS md FROM tiles) SELECT vec_id, {_bits('> md')} AS bits FROM m")
def whash_bits(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", T.median_bits(F.col("v")).alias("bits"))


@query(
    f"""WITH {_TILES} SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: CASE WHEN v[i + 1] > v[i] THEN '1' ELSE '0' END), '') AS bits FROM tiles"""
)
def dhash_bits(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", T.difference_bits(F.col("v")).alias("bits"))


_MATRIX = "(VALUES " + ", ".join(f"({k}, {x}, {w!r}::DOUBLE)" for k, row in enumerate(T.cosine_matrix()) for x, w in enumerate(row)) + ") AS {0}(k, x, w)"


@query(
    f"""WITH {_TILES}, px AS (SELECT vec_id, i, v[i + 1] AS p FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM tiles)),
    half AS (SELECT vec_id, i // 8 AS y, c.k AS kx, sum(p * c.w) AS h FROM px JOIN {_MATRIX.format("c")} ON c.x = i % 8 GROUP BY ALL),
    coef AS (SELECT vec_id, c.k * 8 + kx AS i, round(sum(h * c.w), 9) AS q FROM half JOIN {_MATRIX.format("c")} ON c.x = y GROUP BY ALL, c.k, kx),
    m AS (SELECT vec_id, median(q) AS md FROM coef WHERE i > 0 GROUP BY vec_id)
    SELECT vec_id, string_agg(CASE WHEN q > md THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM coef JOIN m USING (vec_id) GROUP BY vec_id""".replace("GROUP BY ALL, c.k, kx", "GROUP BY vec_id, c.k * 8 + kx")
)
def phash_bits(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", T.dct_bits(F.col("v")).alias("bits"))


@query(
    f"""WITH {_TILES}, b AS (SELECT vec_id, v, {_SUM} / 64 AS mu FROM tiles), a AS (SELECT vec_id, {_bits('>= mu')} AS s FROM b),
    n AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN s[i + 1] = '1' THEN (1::HUGEINT << (63 - i)) ELSE 0::HUGEINT END)) AS h FROM a)
    SELECT vec_id, lpad(format('{{:x}}', h::UBIGINT), 16, '0') AS hex FROM n"""
)
def tile_hash_hex(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", H.to_hex(H.from_bits(T.average_bits(F.col("v")))).alias("hex"))


# A 32 x 32 picture out of each tile: the tile sixteen times, under itself at four times the size.
_SINC = "CASE WHEN {0} = 0 THEN 1 ELSE sin(pi() * {0}) / (pi() * {0}) END"
_PICTURE = f"""{_TILES}, place AS (SELECT i // 32 AS y, i % 32 AS x FROM (SELECT unnest(range(1024)) AS i)),
    px AS (SELECT vec_id, y, x, v[y % 8 * 8 + x % 8 + 1] + 0.5 * v[y // 4 * 8 + x // 4 + 1] AS p FROM tiles, place),
    raw AS (SELECT n, k, s, (s + 0.5 - (k + 0.5) * 32 / n) * n / 32 AS t FROM (SELECT n, unnest(range(n)) AS k FROM (VALUES (8), (9)) AS q(n)), (SELECT unnest(range(32)) AS s)),
    lob AS (SELECT n, k, s, CASE WHEN abs(t) < 3 THEN ({_SINC.format("t")}) * ({_SINC.format("(t / 3)")}) ELSE 0 END AS w FROM raw),
    lan AS (SELECT n, k, s, w / sum(w) OVER (PARTITION BY n, k) AS w FROM lob),
    wide AS (SELECT vec_id, n, k, y, sum(p * w) AS p FROM px JOIN lan ON s = x GROUP BY ALL),
    small AS (SELECT vec_id, wide.n, wide.k AS x, lan.k AS y, sum(p * w) AS p FROM wide JOIN lan ON lan.n = 8 AND lan.s = wide.y GROUP BY ALL),
    cosines AS (SELECT k, s, sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) * cos(pi() * k * (2 * s + 1) / 64) AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(32)) AS s)),
    half AS (SELECT vec_id, k, y, sum(p * w) AS p FROM px JOIN cosines ON s = x GROUP BY ALL),
    low AS (SELECT vec_id, half.k AS x, c.k AS y, sum(p * w) AS p FROM half JOIN cosines c ON c.s = half.y GROUP BY ALL),
    blocks AS (SELECT vec_id, x // 4 AS x, y // 4 AS y, avg(p) AS p FROM px GROUP BY ALL)"""
_SEQ = "string_agg(CASE WHEN {0} THEN '1' ELSE '0' END, '' ORDER BY y, x)"


@query(
    f"""WITH {_PICTURE},
    a AS (SELECT vec_id, {_SEQ.format("p >= m")} AS ahash FROM (SELECT *, avg(p) OVER (PARTITION BY vec_id) AS m FROM small WHERE n = 8) GROUP BY vec_id),
    d AS (SELECT vec_id, {_SEQ.format("r > p")} AS dhash FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM small WHERE n = 9) WHERE x < 8 GROUP BY vec_id),
    pm AS (SELECT vec_id, median(p) AS m FROM low WHERE x + y > 0 GROUP BY vec_id),
    p AS (SELECT vec_id, {_SEQ.format("p > m")} AS phash FROM low JOIN pm USING (vec_id) GROUP BY vec_id),
    wm AS (SELECT vec_id, median(p) AS m FROM blocks GROUP BY vec_id),
    w AS (SELECT vec_id, {_SEQ.format("p > m")} AS whash FROM blocks JOIN wm USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, ahash, dhash, phash, whash FROM a JOIN d USING (vec_id) JOIN p USING (vec_id) JOIN w USING (vec_id)"""
)
def hash_stages(spark: SparkSession, d: str) -> DataFrame:
    """The four hashes of a 32 x 32 picture by all their stages: reductions to 8 x 8 and 9 x 8, cosine transform, block means."""

    def run(parts):
        import numpy as np
        import pandas as pd

        from twinlens.kernels.pixels import hashes

        y, x = np.mgrid[0:32, 0:32]
        for p in parts:
            rows = []
            for vec_id, v in zip(p["vec_id"], p["v"]):
                t = np.asarray(v).reshape(8, 8)
                h = hashes(t[y % 8, x % 8] + 0.5 * t[y // 4, x // 4])
                rows.append((vec_id, *(format(h[k] & (2**64 - 1), "064b") for k in ("ahash", "dhash", "phash", "whash"))))
            yield pd.DataFrame(rows, columns=["vec_id", "ahash", "dhash", "phash", "whash"])

    return _tiles(spark, d).mapInPandas(run, "vec_id bigint, ahash string, dhash string, phash string, whash string")


@query(f"WITH {_TILES}, m AS (SELECT vec_id, v, {_SUM} / 64 AS mu FROM tiles) SELECT vec_id, round(mu, 6) AS luma_mean, round(list_stddev_pop(v), 6) AS luma_std, round(list_median(v), 6) AS luma_median FROM m")
def luma_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _tiles(spark, d).select("vec_id", F.round(T.mean(v), 6).alias("luma_mean"), F.round(T.spread(v), 6).alias("luma_std"), F.round(T.median(v), 6).alias("luma_median"))


_PX = f"""{_TILES}, px AS (SELECT vec_id, i, v[i + 1] AS p FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM tiles))"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("vec_id", F.posexplode("v").alias("i", "p"))


_LEVEL = "CAST(greatest(0, least(255, floor(v[{0}] * 512 + 128))) AS INT) // 64"


@query(
    f"""WITH {_TILES}, t AS (SELECT vec_id, v, unnest(range(0, 21)) AS i FROM tiles),
    b AS (SELECT vec_id, ({_LEVEL.format("3 * i + 1")}) * 16 + ({_LEVEL.format("3 * i + 2")}) * 4 + {_LEVEL.format("3 * i + 3")} AS bin FROM t),
    n AS (SELECT vec_id, bin, count(*) AS n FROM b GROUP BY ALL)
    SELECT vec_id, bin, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY vec_id)), 6) AS share FROM n"""
)
def color_hist_bins(spark: SparkSession, d: str) -> DataFrame:
    """The 64 bins of the two high bits of three channels, of unit length; three numbers of a tile stand for the channels of a pixel."""
    return T.color_bins(_tiles(spark, d).select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 512 + 128))).cast("int")).alias("px")), "vec_id", "px")


# pairs of a tile and the next one of its label
_PAIRS = f"""{_PX}, nxt AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings),
    pp AS (SELECT n.vec_id, n.other, a.i, a.p AS a, b.p AS b FROM nxt n JOIN px a ON a.vec_id = n.vec_id JOIN px b ON b.vec_id = n.other AND b.i = a.i)"""


def _next_of_label(spark: SparkSession, d: str) -> DataFrame:
    """Each tile with the next one of its label as ``n``. A label may hold a large share of all tiles, so they are numbered by steps
    and joined by number."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    numbered = spread_rank(e, ["label"], F.floor(F.col("vec_id") / 1024), [F.col("vec_id")], "__r")
    ahead = numbered.select("label", (F.col("__r") - 1).alias("__r"), F.struct("vec_id", "embedding").alias("n"))
    return numbered.join(ahead, ["label", "__r"]).drop("__r")


def _pixel_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    nxt = _next_of_label(spark, d)
    zipped = F.arrays_zip(v.alias("a"), F.col("n.embedding").cast("array<double>").alias("b"))
    return nxt.select("vec_id", F.col("n.vec_id").alias("other"), F.posexplode(zipped).alias("i", "z")).select("vec_id", "other", "i", "z.a", "z.b")


@query(
    f"""WITH {_PAIRS} SELECT vec_id, other, round(greatest(0, least(1, 1 - sqrt(sum((a - b) * (a - b))) / sqrt(sum(a * a)))), 6) AS nrmse_sim,
    round(CASE WHEN sum((a - b) * (a - b)) = 0 THEN 100 ELSE least(100, 10 * log10(1.0 / (sum((a - b) * (a - b)) / 64))) END, 6) AS psnr,
    round(greatest(0, least(1, corr(a, b))), 6) AS pearson FROM pp GROUP BY ALL"""
)
def pixel_errors(spark: SparkSession, d: str) -> DataFrame:
    diff = F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return _pixel_pairs(spark, d).groupBy("vec_id", "other").agg(
        F.round(clip(1 - F.sqrt(diff) / F.sqrt(F.sum(F.col("a") * F.col("a")))), 6).alias("nrmse_sim"),
        F.round(F.when(diff == 0, 100.0).otherwise(F.least(F.lit(100.0), 10 * F.log10(1.0 / (diff / 64)))), 6).alias("psnr"),
        F.round(clip(F.corr("a", "b")), 6).alias("pearson"),
    )


_MIXED = (
    "list_transform(range(36), lambda i: {0}[(i // 6 + 2) * 8 + i % 6 + 3] - {0}[(i // 6 + 2) * 8 + i % 6 + 1] - {0}[i // 6 * 8 + i % 6 + 3] + {0}[i // 6 * 8 + i % 6 + 1])"
)


@query(
    f"""WITH {_TILES}, nxt AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings),
    m AS (SELECT n.vec_id, n.other, {_MIXED.format("a.v")} AS x, {_MIXED.format("b.v")} AS y FROM nxt n JOIN tiles a ON a.vec_id = n.vec_id JOIN tiles b ON b.vec_id = n.other),
    e AS (SELECT vec_id, other, unnest(x) AS x, unnest(y) AS y FROM m)
    SELECT vec_id, other, round(CASE WHEN stddev_pop(x) < 1e-6 OR stddev_pop(y) < 1e-6 THEN 0 ELSE greatest(0, least(1, corr(x, y))) END, 6) AS grad_corr FROM e GROUP BY ALL"""
)
def gradient_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the mixed second derivatives of a tile and the next one of its label, inside the frame."""
    nxt = _next_of_label(spark, d)
    x, y = T.mixed_derivative(F.col("embedding").cast("array<double>")), T.mixed_derivative(F.col("n.embedding").cast("array<double>"))
    z = nxt.select("vec_id", F.col("n.vec_id").alias("other"), F.explode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("z"))
    flat = (F.stddev_pop("z.x") < 1e-6) | (F.stddev_pop("z.y") < 1e-6)
    corr = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.corr("z.x", "z.y"))))
    return z.groupBy("vec_id", "other").agg(F.round(corr, 6).alias("grad_corr"))


@query(
    f"""WITH {_PAIRS}, g AS (SELECT vec_id, other, covar_samp(b, a) / var_pop(a) AS gain, avg(a) AS ma, avg(b) AS mb FROM pp GROUP BY ALL),
    e AS (SELECT vec_id, other, sum((b - gain * a - (mb - gain * ma)) ** 2) AS res, sum((b - mb) ** 2) AS tot FROM pp JOIN g USING (vec_id, other) GROUP BY ALL)
    SELECT vec_id, other, round(gain, 6) AS gain, round(mb - gain * ma, 6) AS offset_, round(CASE WHEN tot > 1e-9 THEN greatest(0, least(1, 1 - res / tot)) ELSE 1 END, 6) AS r2
    FROM g JOIN e USING (vec_id, other)"""
)
def gain_offset_fit(spark: SparkSession, d: str) -> DataFrame:
    """Sample covariance over population variance, as the fit is defined, and the share of variance this line explains."""
    g = _pixel_pairs(spark, d).groupBy("vec_id", "other").agg(
        (F.covar_samp("b", "a") / F.var_pop("a")).alias("gain"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("b", "a").alias("c")
    )
    left = F.col("vb") - 2 * F.col("gain") * F.col("c") + F.col("gain") * F.col("gain") * F.col("va")
    r2 = F.when(F.col("vb") * 64 > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - left / F.col("vb")))).otherwise(1.0)
    return g.select("vec_id", "other", F.round("gain", 6).alias("gain"), F.round(F.col("mb") - F.col("gain") * F.col("ma"), 6).alias("offset_"), F.round(r2, 6).alias("r2"))


@query(
    f"""WITH {_PAIRS}, blk AS (SELECT vec_id, other, i // 16 AS by_, i % 8 // 2 AS bx, avg(abs(a - b)) AS m, quantile_cont(abs(a - b), 0.95) AS peak FROM pp GROUP BY ALL)
    SELECT vec_id, other, round(avg(CASE WHEN round(m, 9) > 0.15 THEN 1.0 ELSE 0.0 END), 6) AS changed, round(avg(CASE WHEN round(peak, 9) > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS peaked, round(median(m), 6) AS median_block,
      min(CASE WHEN round(peak, 9) > 0.3 THEN bx END) AS x0, max(CASE WHEN round(peak, 9) > 0.3 THEN bx END) AS x1, min(CASE WHEN round(peak, 9) > 0.3 THEN by_ END) AS y0, max(CASE WHEN round(peak, 9) > 0.3 THEN by_ END) AS y1 FROM blk GROUP BY ALL"""
)
def block_maps(spark: SparkSession, d: str) -> DataFrame:
    """Share of changed blocks, share of peaked blocks, the median block and the box of the peaks."""
    p = _pixel_pairs(spark, d).withColumns({"delta": F.abs(F.col("a") - F.col("b")), "by_": F.expr("i div 16"), "bx": F.expr("i % 8 div 2")})
    blk = p.groupBy("vec_id", "other", "by_", "bx").agg(F.avg("delta").alias("m"), F.percentile("delta", 0.95).alias("peak"))
    peaked = F.round("peak", 9) > 0.3
    return blk.groupBy("vec_id", "other").agg(
        F.round(F.avg(F.when(F.round("m", 9) > 0.15, 1.0).otherwise(0.0)), 6).alias("changed"),
        F.round(F.avg(F.when(peaked, 1.0).otherwise(0.0)), 6).alias("peaked"),
        F.round(F.median("m"), 6).alias("median_block"),
        F.min(F.when(peaked, F.col("bx"))).alias("x0"),
        F.max(F.when(peaked, F.col("bx"))).alias("x1"),
        F.min(F.when(peaked, F.col("by_"))).alias("y0"),
        F.max(F.when(peaked, F.col("by_"))).alias("y1"),
    )


_ORIENT = "(VALUES " + ", ".join(f"('{n}', {k}, [{', '.join(map(str, p))}])" for k, (n, p) in enumerate(T.ORIENTATIONS.items())) + ") AS o(name, rank, perm)"


@query(
    f"""WITH {_TILES}, q AS (SELECT v AS qv FROM tiles WHERE vec_id = (SELECT min(vec_id) FROM tiles)),
    s AS (SELECT vec_id, name, rank, v, list_transform(perm, lambda i: v[i + 1]) AS t, qv FROM tiles, {_ORIENT}, q),
    a AS (SELECT vec_id, name, rank, 1 - list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (t[i] >= mt) <> (qv[i] >= mq) THEN 1 ELSE 0 END)) / 64.0::DOUBLE AS sim
      FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, b: a + b) / 64 AS mt, list_reduce(list_prepend(0.0::DOUBLE, qv), lambda a, b: a + b) / 64 AS mq FROM s)),
    b AS (SELECT vec_id, max(sim) AS top, arg_max(name, (sim, -rank)) AS best, max(sim) FILTER (name = 'identity') AS plain FROM a GROUP BY vec_id)
    SELECT vec_id, CASE WHEN top - plain >= 0.08 THEN best ELSE 'identity' END AS orientation, round(CASE WHEN top - plain >= 0.08 THEN top ELSE plain END, 6) AS sim FROM b"""
)
def best_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Of the eight orientations the most similar to the query tile (the first); another than the
    identity must be better by the margin."""
    t = _tiles(spark, d).withColumn("mt", T.mean(F.col("v")))
    q = t.orderBy("vec_id").limit(1).select(F.transform("v", lambda x: x >= F.col("mt")).alias("q"))
    scored = t.crossJoin(F.broadcast(q))

    def sim(name: str):
        bits = F.transform(T.oriented(F.col("v"), name), lambda x: x >= F.col("mt"))
        same = F.aggregate(F.zip_with(bits, "q", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return same / 64.0

    all_ = F.array(*(F.struct(sim(n).alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(T.ORIENTATIONS)))
    best = scored.select("vec_id", F.array_max(all_).alias("b"), sim("identity").alias("plain"))
    turn = F.col("b.s") - F.col("plain") >= 0.08
    return best.select("vec_id", F.when(turn, F.col("b.name")).otherwise("identity").alias("orientation"), F.round(F.when(turn, F.col("b.s")).otherwise(F.col("plain")), 6).alias("sim"))


# ---- vectors --------------------------------------------------------------------------------------


@query(
    f"""WITH {_TILES}, q AS (SELECT v AS qv FROM tiles WHERE vec_id = (SELECT min(vec_id) FROM tiles)),
    s AS (SELECT vec_id, list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))) AS c FROM tiles, q)
    SELECT vec_id, round(greatest(-1, least(1, c)), 6) AS cosine, round(greatest(0, least(1, c)), 6) AS hist_cosine FROM s"""
)
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """One query vector against all: a cross join whose build side is one row."""
    t = _tiles(spark, d)
    q = t.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))
    s = t.crossJoin(F.broadcast(q))
    return s.select("vec_id", F.round(V.cosine(F.col("v"), F.col("q")), 6).alias("cosine"), F.round(V.histogram_cosine(F.col("v"), F.col("q")), 6).alias("hist_cosine"))


@query(
    f"""WITH {_TILES}, n AS (SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS u FROM tiles) SELECT vec_id, round(list_sum(u), 4) AS total, CAST(len(u) AS INTEGER) AS length FROM n"""
)
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = F.transform(V.l2_normalise(F.col("v")), lambda x: F.round(x, 6))
    return _tiles(spark, d).select("vec_id", u.alias("u")).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("u").alias("length"))


@query(
    """WITH g AS (SELECT vec_id, cid, backend, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM descriptors WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    nn AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM g),
    p AS (SELECT *, lead(vec_id) OVER w AS o, lead(v) OVER w AS ov, lead(n) OVER w AS onn, lead(backend) OVER w AS ob FROM nn WINDOW w AS (PARTITION BY left(cid, 8) ORDER BY vec_id))
    SELECT vec_id, o AS other, CASE WHEN backend <> ob THEN 'mismatch(' || backend || '/' || ob || ')' ELSE backend END AS backend,
    round(CASE WHEN backend <> ob OR len(v) <> len(ov) OR n * onn = 0 THEN 0 ELSE greatest(0, least(1, list_inner_product(v, ov[1:len(v)]) / (n * onn))) END, 6) AS similarity FROM p WHERE o IS NOT NULL AND (backend <> ob OR len(v) = len(ov))
    UNION ALL SELECT vec_id, o, backend, 0 FROM p WHERE o IS NOT NULL AND backend = ob AND len(v) <> len(ov)"""
)
def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each descriptor against the next one among candidates of neighbouring ids."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    g = table(spark, d, "descriptors").where(F.size("vector") > 0).where(finite)
    w = Window.partitionBy(F.left("cid", F.lit(8))).orderBy("vec_id")
    p = g.withColumn("o", F.lead(F.struct("vec_id", "vector", "backend")).over(w)).where("o IS NOT NULL")
    sim, backend = V.embedding_similarity(F.col("vector"), F.col("o.vector"), F.col("backend"), F.col("o.backend"))
    return p.select("vec_id", F.col("o.vec_id").alias("other"), backend.alias("backend"), F.round(sim, 6).alias("similarity"))
