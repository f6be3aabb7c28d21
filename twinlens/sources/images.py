"""Bytes and pixels (S6, S10-S12, K2): inline data, files, folders.

Nothing here raises for a bad row: the row keeps its place and says what went wrong in ``error``.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.config import LIMITS
from twinlens.functions import urls as U
from twinlens.kernels.pixels import EXIF_TURN, exif_orientation, orient, png_decode, png_encode
from twinlens.workspace import Workspace


def inline_bytes(url: Column) -> Column:
    """The bytes of a data address, after its first comma; null if they aren't base64."""
    return F.try_to_binary(F.regexp_extract(url, r"(?s)^data:[^,]*,(.*)$", 1), F.lit("base64"))


def data_url(data: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(data))


def folder_hits(spark: SparkSession, folder: str, engine: str = "corpus", query_sha: str | None = None) -> DataFrame:
    """Image files below a folder as hits, with their bytes; files with the bytes of the query image are left out. A folder
    that holds no image is an error, as with an engine that returns nothing it can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    root = folder.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.col("path"), F.lit("^file:/*"), F.lit("/"))
    own = files.where(U.file_suffix(name) != "")
    if own.drop("content").isEmpty():
        raise ValueError(f"no images in {folder}")
    if query_sha:
        own = own.where(F.sha2("content", 256) != query_sha)
    return own.select(
        F.lit(engine).alias("engine"),
        F.lit("from the folder").alias("engine_label"),
        F.concat(F.lit("/corpus/"), F.ltrim(F.replace(rel, F.lit(root), F.lit("")), F.lit("/"))).alias("url"),
        F.concat(F.lit("file://"), rel).alias("page_url"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("title"),
        F.col("content").alias("data"),
    )


#: An address's content type and bytes; raises what goes wrong.
Fetch = Callable[[str], tuple[str, bytes]]


def http_fetch(url: str, limit: int = LIMITS.download_bytes, timeout: float = 20.0) -> tuple[str, bytes]:
    """Download an address, no more than one byte beyond the limit."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "twinlens"}), timeout=timeout) as answer:
        return answer.headers.get("Content-Type") or "", answer.read(limit + 1)


def fetched(urls: DataFrame, fetch: Fetch = http_fetch) -> DataFrame:
    """(url, data, error) of each different address in ``urls``: types that aren't images and bytes beyond the
    limit are refused, and a failure is the row's error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 8):
                rows = []
                for url in p["url"].iloc[at : at + 8]:
                    try:
                        rows.append((url, *fetch(url), None))
                    except Exception as e:
                        rows.append((url, None, None, f"download failed: {e}"))
                yield pd.DataFrame(rows, columns=["url", "kind", "data", "error"], dtype=object)

    got = urls.select("url").where("url IS NOT NULL").distinct().mapInPandas(run, "url string, kind string, data binary, error string")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~U.content_type_allowed(F.col("kind")), F.concat(F.lit("not an image: "), "kind"))
        .when(F.octet_length("data") == 0, "empty file")
        .when(F.octet_length("data") > LIMITS.download_bytes, "too large")
    )
    return got.select("url", F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))


def load_bytes(hits: DataFrame, corpus: DataFrame | None = None, fetch: Fetch | None = None) -> DataFrame:
    """Adds ``data`` and ``error``: inline addresses are decoded, corpus addresses joined with the
    folder's files, and those on the network are fetched, or marked where no fetcher is given."""
    route = U.fetch_route(F.col("url"))
    out = hits.withColumn("__route", route).withColumn("data", F.when(F.col("__route") == "data", inline_bytes(F.col("url"))))
    out = out.withColumn("__refused", F.lit(None).cast("string"))
    sources = []
    if corpus is not None:
        sources.append(corpus.select("url", F.col("data").alias("__file"), F.lit(None).cast("string").alias("__why")))
    if fetch is not None:
        got = fetched(hits.where(route == "http"), fetch)
        sources.append(got.select("url", F.col("data").alias("__file"), F.col("error").alias("__why")))
    for files in sources:
        out = out.join(files, "url", "left").withColumns({"data": F.coalesce("data", "__file"), "__refused": F.coalesce("__refused", "__why")}).drop("__file", "__why")
    size = F.octet_length("data")
    error = (
        F.when(F.col("__refused").isNotNull(), F.col("__refused"))
        .when(F.col("data").isNull(), F.when(F.col("__route") == "http", "not fetched").otherwise("no data"))
        .when(size == 0, "empty file")
        .when(size > LIMITS.upload_bytes, "too large")
    )
    return out.withColumn("error", error).withColumn("data", F.when(error.isNull(), F.col("data"))).drop("__route", "__refused")


def read_rgb(data: bytes) -> np.ndarray:
    """Upright RGB pixels of image bytes; raises ValueError for what can't be read here."""
    if not data:
        raise ValueError("empty file")
    if len(data) > LIMITS.upload_bytes:
        raise ValueError("too large")
    return png_decode(data)


def _as_png(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, sha256, head of the file, and the pixels the JVM decoded: an upright PNG of them."""
    for p in parts:
        for at in range(0, len(p), 16):
            rows = []
            for path, sha, head, h, w, n, raw in p.iloc[at : at + 16].itertuples(index=False):
                if raw is None or not h or h < 0:
                    rows.append((path, None, None, None, sha, "undecodable"))
                    continue
                a = np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w), int(n))
                rgb = np.repeat(a, 3, axis=2) if n == 1 else a[:, :, 2::-1]
                rgb = orient(rgb, EXIF_TURN[exif_orientation(bytes(head))])
                rows.append((path, png_encode(rgb, 1), rgb.shape[1], rgb.shape[0], sha, None))
            yield pd.DataFrame(rows, columns=["path", "data", "width", "height", "sha256", "error"])


_PNG = "path string, data binary, width int, height int, sha256 string, error string"


def _plain_path(c: str) -> Column:
    return F.regexp_replace(c, "^file:/*", "/")


def decode_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, data as PNG, width, height, sha256, error) of the files below a folder, whatever ImageIO reads:
    decoded in the JVM, turned upright by their EXIF orientation, channels put in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 65536).alias("head"))
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")
    both = files.join(pixels, _plain_path("path") == _plain_path("origin"), "left").select("path", "sha256", "head", "height", "width", "nChannels", F.col("data").alias("raw"))
    return both.mapInPandas(_as_png, _PNG)


def normalised(df: DataFrame, data: str = "data") -> DataFrame:
    """``df`` with images of other formats in column ``data`` replaced by upright PNGs: what ImageIO reads, which is JPEG, GIF
    (its first picture), BMP and TIFF. Each different content is written once to the shared folder, named by its hash, and read by
    Spark's image source; PNGs and what can't be read stay as they are."""
    spark = df.sparkSession
    ws = Workspace(spark, "formats")
    keyed = df.withColumn("__sha", F.when(F.substring(F.col(data), 1, 8) != F.lit(b"\x89PNG\r\n\x1a\n"), F.sha2(data, 256)))
    fits = F.octet_length(data).between(1, LIMITS.upload_bytes)
    other = keyed.where(F.col("__sha").isNotNull() & fits).groupBy("__sha").agg(F.first(data).alias("raw"))
    folder = ws.path("files")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for p in parts:
            for sha, raw in p.itertuples(index=False):
                store.create_dir(f"{root}/{sha[:2]}", recursive=True)
                with store.open_output_stream(f"{root}/{sha[:2]}/{sha}") as f:  # the same bytes if a task runs twice
                    f.write(raw)
            yield pd.DataFrame({"sha": p["__sha"], "head": [bytes(r[:65536]) for r in p["raw"]]})

    heads = ws.save(other.mapInPandas(write, "sha string, head binary"), "heads")
    if heads.isEmpty():
        return df
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*").withColumn("sha", F.regexp_extract("origin", "([0-9a-f]{64})$", 1))
    both = heads.join(pixels.hint("merge"), "sha", "left").select(F.col("sha").alias("path"), "sha", "head", "height", "width", "nChannels", F.col("data").alias("raw"))
    png = ws.save(both.mapInPandas(_as_png, _PNG).where("error IS NULL").select(F.col("sha256").alias("__sha"), F.col("data").alias("__png")), "pngs")
    ws.drop_paths([folder])
    out = keyed.join(png.hint("merge"), "__sha", "left")
    return out.withColumn(data, F.coalesce("__png", data)).select(*df.columns)
