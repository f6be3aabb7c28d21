"""Hits as a stream: windowed counts with late rows, deduplication within a watermark, and an
incremental count of addresses by micro-batch.

The stream's file source reads new files as they come; a run here takes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.urls import canonical_url
from twinlens.streaming.state import BucketTable
from twinlens.workspace import Workspace


def hit_stream(spark: SparkSession, path: str) -> DataFrame:
    """The hits below a path as a stream, with found_at as event time."""
    schema = spark.read.parquet(path).schema
    # as a pattern: a plain path would have to be a folder
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn("event_time", F.coalesce("found_at", "loaded_at").cast("timestamp"))


def unique_hits(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each delivery once: a seq seen within the watermark is dropped. What comes later than ``late`` is dropped too, which is what
    bounds the state."""
    return stream.where(F.col("seq").isNotNull()).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["seq"])


def windowed_counts(stream: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Hits and summed score of each engine and window, final once the watermark has passed."""
    return (
        stream.withWatermark("event_time", late)
        .groupBy(F.window("event_time", window), "engine")
        .agg(F.count("*").alias("hits"), F.sum("engine_score").alias("score"))
        .select(F.col("window.start").alias("start"), "engine", "hits", "score")
    )


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "30 days") -> DataFrame:
    """Bursts of hits of a run: windows that end after a gap."""
    return (
        stream.withWatermark("event_time", late)
        .groupBy(F.session_window("event_time", gap), "run_id")
        .agg(F.count("*").alias("hits"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "run_id", "hits")
    )


def run_to_end(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Process what is available and return the result as a table. In append mode windows the watermark hasn't passed stay
    open and are not in the result. In update mode each batch's changed rows replace those of equal ``keys``, and the stream's
    state holds only what the watermark hasn't passed. Complete mode, the one other mode session windows allow, keeps all."""
    spark = stream.sparkSession
    ws = Workspace(spark, "stream")
    out, state = ws.path("out"), ws.path("state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    if mode == "update":
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
        held = BucketTable(spark, ws, ddl, keys)
        writer.foreachBatch(held.replace).start().awaitTermination()
        return held.table()
    writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def count_addresses(stream: DataFrame) -> DataFrame:
    """Hits of each canonical address, merged batch by batch into a table in buckets."""
    spark = stream.sparkSession
    ws = Workspace(spark, "addresses")
    held = BucketTable(spark, ws, "canon string, hits bigint, first_seq bigint", ["canon"])

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("canon").agg(F.sum("hits").alias("hits"), F.min("first_seq").alias("first_seq"))

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.where("url IS NOT NULL").groupBy(canonical_url(F.col("url")).alias("canon")).agg(F.count("*").alias("hits"), F.min("seq").alias("first_seq"))
        held.upsert(new, epoch, add)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", ws.path("state")).trigger(availableNow=True).start().awaitTermination()
    return held.table()
