"""Hits out of the answers of search engines, as DataFrame transformations.

Each takes a DataFrame with ``engine`` and ``body`` (the answer's text) and returns hits; ``ordinal``
is the place within the answer, so that first-wins steps have an order. Bodies that are null, empty
or no answer at all give no hits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TAG_JSON = (
    "tags array<struct<actions:array<struct<data:struct<value:array<struct<contentUrl:string, hostPageUrl:string, name:string, "
    "thumbnail:struct<width:int, height:int>>>>>>>>"
)
MATCH_JSON = "result struct<matches:array<struct<image_url:string, domain:string, score:double, width:int, height:int, backlinks:array<struct<url:string, backlink:string>>>>>"


def _hits(df: DataFrame, url: Column, label: Column, page: Column, title: Column, width: Column, height: Column, score: Column) -> DataFrame:
    return df.select(
        "engine",
        "ordinal",
        url.alias("url"),
        F.coalesce(label, F.lit("")).alias("engine_label"),
        F.coalesce(page, F.lit("")).alias("page_url"),
        F.coalesce(title, F.lit("")).alias("title"),
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        score.cast("double").alias("engine_score"),
    ).where(F.col("url").isNotNull() & (F.col("url") != ""))


def hits_from_tags(df: DataFrame) -> DataFrame:
    """Answers of tags holding actions holding values; the image's address, else that of its page."""
    t = df.select("engine", F.from_json("body", TAG_JSON).alias("j"))
    t = t.select("engine", F.posexplode("j.tags").alias("i", "tag")).select("engine", "i", F.posexplode("tag.actions").alias("k", "action"))
    t = t.select("engine", "i", "k", F.posexplode("action.data.value").alias("m", "v"))
    t = t.withColumn("ordinal", F.format_string("%05d.%05d.%05d", "i", "k", "m"))
    url = F.coalesce(F.nullif(F.col("v.contentUrl"), F.lit("")), F.col("v.hostPageUrl"))
    none = F.lit(None)
    return _hits(t, url, none.cast("string"), F.col("v.hostPageUrl"), F.col("v.name"), F.col("v.thumbnail.width"), F.col("v.thumbnail.height"), none)


def hits_from_matches(df: DataFrame, service: str = "match") -> DataFrame:
    """Answers of scored matches; only the first backlink of each counts."""
    t = df.select("engine", F.from_json("body", MATCH_JSON).alias("j")).select("engine", F.posexplode("j.result.matches").alias("i", "m"))
    t = t.withColumn("ordinal", F.format_string("%05d", "i")).withColumn("b", F.try_element_at("m.backlinks", F.lit(1)))
    url = F.coalesce(F.nullif(F.col("b.url"), F.lit("")), F.col("m.image_url"))
    label = F.trim(F.concat_ws(" ", F.lit(service), F.col("m.score").cast("string")))
    return _hits(t, url, label, F.col("b.backlink"), F.col("m.domain"), F.col("m.width"), F.col("m.height"), F.col("m.score"))


def hits_from_page(df: DataFrame, drop: list[str], suffixes: str = "jpg|jpeg|png|webp", label: str = "Similar") -> DataFrame:
    """Image addresses in a page's text, unescaped, without those of hosts in ``drop``, distinct, in order."""
    text = F.replace(F.replace(F.col("body"), F.lit("\\u003d"), F.lit("=")), F.lit("\\/"), F.lit("/"))
    found = F.regexp_extract_all(text, F.lit(rf"(https?://[^\s\"'<>\\]+?\.(?:{suffixes}))(?![a-zA-Z0-9])"), F.lit(1))
    t = df.select("engine", F.posexplode(F.array_distinct(found)).alias("i", "url"))
    for host in drop:
        t = t.where(~F.col("url").contains(host))
    t = t.withColumn("ordinal", F.format_string("%05d", "i"))
    none = F.lit(None)
    return _hits(t, F.col("url"), F.lit(label), none.cast("string"), none.cast("string"), none, none, none)


#: Sends one request, given a step's name, an address and the bytes to upload or None, and returns the answer's text.
Send = Callable[[str, str, bytes | None], str]


def page_search(image: bytes, send: Send, upload_url: str, results_url: str, token: str = "id", warm_url: str | None = None) -> str:
    """The results page of an engine that takes an upload first (S4, S5): an optional first visit for its cookies, the
    upload, the token out of its answer (an ``id`` in a page or a ``name`` in JSON), and the page of results named by it,
    which ``results_url`` has as {token}. Raises ValueError where an answer holds no token."""
    if warm_url:
        send("visit", warm_url, None)
    answer = send("upload", upload_url, image)
    if token == "id":
        found = re.search(r"/upload/([A-Za-z0-9_\-]{20,})", answer)
        name = found and found.group(1)
    else:
        try:
            given = json.loads(answer)
        except ValueError as e:
            raise ValueError("the upload's answer is no JSON") from e
        name = given.get("uploaded-image") or given.get("uploadedImage") if isinstance(given, dict) else None
    if not name:
        raise ValueError("the upload's answer names no image")
    return send("results", results_url.format(token=name), None)


def answer_search(image: bytes, send: Send, url: str, key: str | None) -> str:
    """The answer of an engine with an interface and a key (S2, S3). Raises ValueError without a key."""
    if not key:
        raise ValueError("no key is set")
    return send("search", url, image)


def hits_or_failure(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(engine, failure) of the engines whose answers gave no hit at all."""
    return answers.select("engine").distinct().join(hits.select("engine").distinct(), "engine", "left_anti").withColumn("failure", F.lit("no results that can be read"))


def number_hits(hits: DataFrame) -> DataFrame:
    """``seq`` by engine and ordinal, so that the order doesn't hang on which engine answered first. Hits
    are ranked within their engine; the engines' offsets are a table of one row an engine."""
    counts = hits.groupBy("engine").agg(F.count("*").alias("n"))
    before = Window.orderBy("engine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("engine", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("engine").orderBy("ordinal")))
    return ranked.join(F.broadcast(offsets), "engine").withColumn("seq", F.col("offset") + F.col("rank")).drop("offset", "rank")
