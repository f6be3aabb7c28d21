"""Queries for connectors, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.plans.relational import CANON
from twinlens.session import table
from twinlens.sources import connectors as C
from twinlens.sources import images as I
from twinlens.streaming import ingest
from twinlens.workspace import Workspace

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Rows of one answer or page.
BLOCK = 256

_CLEAN = r"(SELECT DISTINCT seq, engine, url, page_url, title, width, height, engine_score FROM hits)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select("seq", "engine", "url", "page_url", "title", "width", "height", "engine_score").distinct()


@query(f"SELECT engine, count(*) AS hits, count(DISTINCT url) AS urls, CAST(sum(width) AS BIGINT) AS width FROM (SELECT engine, coalesce(nullif(url, ''), page_url) AS url, width FROM {_CLEAN} c) x WHERE url <> '' GROUP BY engine")
def tag_json_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as nested tag answers, one answer an engine and block of hits, and read back."""
    h = _once(spark, d)
    value = F.struct(F.col("url").alias("contentUrl"), F.col("page_url").alias("hostPageUrl"), F.col("title").alias("name"), F.struct("width", "height").alias("thumbnail"))
    answers = h.groupBy("engine", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.collect_list(value).alias("value")).alias("data"))).alias("actions"))).alias("tags"))).alias("body"))
    return C.hits_from_tags(answers).groupBy("engine").agg(F.count("*").alias("hits"), F.count_distinct("url").alias("urls"), F.sum("width").alias("width"))


@query(
    f"""SELECT engine, count(*) AS hits, count(engine_score) AS scored, round(sum(engine_score), 4) AS score, count(*) FILTER (label = 'match') AS unlabelled
    FROM (SELECT engine, engine_score, CASE WHEN engine_score IS NULL THEN 'match' END AS label, coalesce(nullif(url, ''), page_url) AS url FROM {_CLEAN} c) x WHERE url <> '' GROUP BY engine"""
)
def match_json_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as scored match answers and read back."""
    h = _once(spark, d)
    links = F.array(F.struct("url", F.col("page_url").alias("backlink")))
    m = F.struct(F.col("page_url").alias("image_url"), F.col("title").alias("domain"), F.col("engine_score").alias("score"), "width", "height", links.alias("backlinks"))
    answers = h.groupBy("engine", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.to_json(F.struct(F.struct(F.collect_list(m).alias("matches")).alias("result"))).alias("body"))
    hits = C.hits_from_matches(answers)
    return hits.groupBy("engine").agg(
        F.count("*").alias("hits"), F.count("engine_score").alias("scored"), F.round(F.sum("engine_score"), 4).alias("score"), F.count_if(F.col("engine_label") == "match").alias("unlabelled")
    )


@query(
    r"""WITH p AS (SELECT engine, run_id, unnest(regexp_extract_all(replace(replace(url, chr(92) || 'u003d', '='), '\/', '/'), '(https?://[^\s"''<>\\]+?\.(?:jpg|jpeg|png|webp))(?:[^a-zA-Z0-9]|$)', 1)) AS url FROM hits)
    SELECT engine, run_id, count(DISTINCT url) AS urls FROM p WHERE NOT contains(url, 'static.') GROUP BY ALL"""
)
def page_scrape(spark: SparkSession, d: str) -> DataFrame:
    """Image addresses scraped out of page text (the addresses of a run and engine in blocks of hits, in quotes), distinct, without some hosts."""
    h = table(spark, d, "hits").where("url IS NOT NULL")
    pages = h.groupBy("engine", "run_id", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit('<img src="'), "url", F.lit('">')))).alias("body"))
    hits = C.hits_from_page(pages.withColumn("engine", F.concat_ws("\x01", "engine", "run_id")), ["static."])
    parts = F.split("engine", "\x01")
    return hits.groupBy(parts[0].alias("engine"), parts[1].alias("run_id")).agg(F.count_distinct("url").alias("urls"))


@query(
    """SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha, CASE WHEN octet_length(encode(text)) = 0 THEN 'empty file' END AS error FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, NULL, NULL, 'no data' FROM documents WHERE text IS NULL"""
)
def inline_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as data addresses, decoded by the downloader."""
    docs = table(spark, d, "documents").select("doc_id", I.data_url(F.encode("text", "UTF-8")).alias("url"))
    got = I.load_bytes(docs)
    error = F.when(F.col("url").isNull(), "no data").otherwise(F.col("error"))
    return got.select(
        "doc_id",
        F.octet_length(F.coalesce("data", F.when(F.col("error") == "empty file", F.lit(b"")))).cast("bigint").alias("bytes"),
        F.sha2(F.coalesce("data", F.when(F.col("error") == "empty file", F.lit(b""))), 256).alias("sha"),
        error.alias("error"),
    )


@query("SELECT run_id, count(*) AS hits, count(DISTINCT engine) AS engines FROM hits GROUP BY run_id")
def run_store(spark: SparkSession, d: str) -> DataFrame:
    """Runs written as a table partitioned by engine, and read back with the partitions as a column."""
    ws = Workspace(spark, "runs")
    path = ws.path("hits")
    table(spark, d, "hits").select("run_id", "seq", "engine").write.partitionBy("engine").parquet(path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("hits"), F.count_distinct("engine").alias("engines"))


@query(
    "SELECT date_trunc('day', coalesce(found_at, loaded_at)) AS start, engine, count(*) AS hits, round(coalesce(sum(engine_score), 0), 4) AS score FROM hits GROUP BY ALL"
)
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the stream of hits."""
    got = ingest.run_to_end(ingest.windowed_counts(ingest.hit_stream(spark, f"{d}/hits.parquet")), "update", ["start", "engine"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "engine", "hits", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


@query(f"SELECT canon, count(*) AS hits, min(seq) AS first_seq FROM (SELECT seq, {CANON} AS canon FROM hits WHERE url IS NOT NULL) x GROUP BY canon")
def stream_address_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.count_addresses(ingest.hit_stream(spark, f"{d}/hits.parquet"))


@query("SELECT engine, count(DISTINCT seq) AS hits FROM hits GROUP BY engine")
def stream_unique_hits(spark: SparkSession, d: str) -> DataFrame:
    unique = ingest.unique_hits(ingest.hit_stream(spark, f"{d}/hits.parquet")).select("seq", "engine")
    return ingest.run_to_end(unique, "append").groupBy("engine").agg(F.count("*").alias("hits"))


@query(
    """WITH t AS (SELECT run_id, coalesce(found_at, loaded_at) AS ts FROM hits), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM t),
    s AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT run_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS hits FROM s GROUP BY run_id, k"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    got = ingest.run_to_end(ingest.sessions(ingest.hit_stream(spark, f"{d}/hits.parquet")))
    return got.select("run_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "hits")
