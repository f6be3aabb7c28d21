"""What a service would offer, as functions that return DataFrames (K4, K5, V2, V3)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import config
from twinlens.operators import images
from twinlens.plans import pipeline
from twinlens.sources import engines


def list_engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, True) for n in engines.registered()], "engine string, available boolean")


def list_thresholds(spark: SparkSession) -> DataFrame:
    """One row a group of parameters, the values as JSON."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in config.thresholds().items()], "parameters string, value string")


class Run:
    """A finished run of one or more query images."""

    def __init__(self, originals: DataFrame, report: pipeline.Report, outcomes: DataFrame):
        self.originals, self.report, self.outcomes = originals, report, outcomes

    def status(self) -> DataFrame:
        """Counters by query; a query without hits is complete with zeros."""
        return self.originals.select("query_id").join(self.report.counts(), "query_id", "left").na.fill(0)

    def cards(self) -> DataFrame:
        """Cards in report order."""
        return self.report.cards.orderBy("query_id", "group_rank", F.desc("confidence"), "representative_cid")

    def candidate(self, query_id: str, cid: str) -> DataFrame:
        return self.report.uniques.where((F.col("query_id") == query_id) & (F.col("cid") == cid))

    def compare(self, query_id: str, cid: str, size: int = 720) -> DataFrame:
        """The aligned rendering of a candidate with how it was aligned."""
        pair = self.candidate(query_id, cid).select("query_id", "cid", F.col("data").alias("b")).join(self.originals.select("query_id", F.col("data").alias("a")), "query_id")
        return images.renderings(pair, ["query_id", "cid"], "a", "b", size)

    def view(self, query_id: str, cid: str, name: str, size: int = 720) -> DataFrame:
        """One picture of the rendering; an unknown name raises ValueError before any work is done."""
        if name not in images.VIEWS:
            raise ValueError(f"unknown view {name!r}")
        return images.view(self.compare(query_id, cid, size), name)

    def store(self, path: str) -> None:
        """Originals unchanged, and every table of the run, below a folder."""
        tables = {k: getattr(self.report, k) for k in ("hits", "uniques", "prints", "decisions", "verdicts", "cards")}
        for name, table in {"originals": self.originals, **tables}.items():
            table.write.mode("errorifexists").parquet(f"{path}/{name}")


def search(spark: SparkSession, image: bytes, query_id: str = "q1", names: list[str] | None = None) -> Run:
    """Ask the engines, verify what they return, merge it."""
    hits, outcomes = engines.search(spark, image, names)
    originals = spark.createDataFrame([(query_id, bytearray(image))], "query_id string, data binary")
    return Run(originals, pipeline.run(originals, hits.withColumn("query_id", F.lit(query_id))), outcomes)
