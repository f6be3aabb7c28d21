"""Engines as Python data sources, with a registry."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinlens.workspace import Workspace

HIT_DDL = "seq bigint, url string, engine string, engine_label string, page_url string, title string, width int, height int, engine_score double, data binary, failure string"
_FIELDS = [f.split()[0] for f in HIT_DDL.split(", ")]

#: name -> function of the image's bytes that returns hits as dictionaries.
_ENGINES: dict[str, Callable[[bytes], list[dict]]] = {}


def register(name: str, search: Callable[[bytes], list[dict]]) -> None:
    _ENGINES[name] = search


def registered() -> list[str]:
    return sorted(_ENGINES)


class _Engine(InputPartition):
    def __init__(self, name: str, search: Callable[[bytes], list[dict]]):
        super().__init__(name)
        self.name, self.blob = name, cloudpickle.dumps(search)  # by value: a worker needn't know the engine's module


class _Reader(DataSourceReader):
    def __init__(self, engines: list[_Engine], image: bytes):
        self.engines, self.image = engines, image

    def partitions(self) -> list[InputPartition]:
        return self.engines

    def read(self, part: InputPartition) -> Iterator[tuple]:
        try:
            hits = cloudpickle.loads(part.blob)(self.image)
        except Exception as e:  # one engine's failure doesn't end the search
            yield tuple({"engine": part.name, "failure": str(e) or type(e).__name__}.get(k) for k in _FIELDS)
            return
        for i, h in enumerate(hits):
            row = {"engine": part.name, "seq": i + 1, "engine_label": "", "page_url": "", "title": ""} | h
            yield tuple(row.get(k) for k in _FIELDS)


class EngineSource(DataSource):
    """``engines``: the engines' functions by name, pickled; ``image``: the query image; both in base64.

    The functions travel with the read, as the process that plans it has a registry of its own."""

    @classmethod
    def name(cls) -> str:
        return "engines"

    def schema(self) -> str:
        return HIT_DDL

    def reader(self, schema) -> DataSourceReader:
        chosen = cloudpickle.loads(base64.b64decode(self.options["engines"]))
        return _Reader([_Engine(n, f) for n, f in sorted(chosen.items())], base64.b64decode(self.options["image"]))


def _demo(image: bytes) -> list[dict]:
    from twinlens.kernels.pixels import png_decode
    from twinlens.sources.demo import result_set

    return result_set(png_decode(image))


register("demo", _demo)


def search(spark: SparkSession, image: bytes, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes): all engines' hits, one partition each, and per engine its count or error.
    Names that aren't registered are left out; without any left, all engines are asked."""
    chosen = {n: _ENGINES[n] for n in names or () if n in _ENGINES} or dict(_ENGINES)
    spark.dataSource.register(EngineSource)
    options = {"engines": base64.b64encode(cloudpickle.dumps(chosen)).decode(), "image": base64.b64encode(image).decode()}
    ws = Workspace(spark, "engines")
    rows = ws.save(spark.read.format("engines").options(**options).load(), "answers")  # each engine is asked once
    outcomes = rows.groupBy("engine").agg(F.count_if(F.col("failure").isNull()).alias("count"), F.max("failure").alias("error"))
    asked = spark.createDataFrame([(n,) for n in sorted(chosen)], "engine string")
    outcomes = asked.join(outcomes, "engine", "left").select("engine", F.coalesce("count", F.lit(0)).alias("count"), "error")
    return rows.where("failure IS NULL").drop("failure"), outcomes
