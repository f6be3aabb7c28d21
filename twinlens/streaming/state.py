"""A keyed table that micro-batches bring up to date, in buckets: a batch reads and writes only those it meets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.workspace import Workspace


class BucketTable:
    """``keys`` are unique; each bucket of them is a folder, replaced as a whole. A batch that the stream gives again is
    left out. The table lives as long as the stream's own checkpoint, in the same workspace: a stream that starts anew starts both."""

    def __init__(self, spark: SparkSession, ws: Workspace, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.ws, self.schema, self.keys, self.buckets = spark, ws, schema, keys, buckets
        self.folders: dict[int, str] = {}
        self.epoch = -1

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        return self._read(list(self.folders.values()))

    def upsert(self, batch: DataFrame, epoch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``merge`` makes the new rows of the met buckets out of their old rows and the batch."""
        if epoch <= self.epoch:
            return
        new = self.ws.save(batch, "batch")
        met = [r[0] for r in new.select(self._bucket()).distinct().collect()]
        rows = merge(self._read([self.folders[b] for b in met if b in self.folders]), new)
        path = self.ws.path("table")
        self.ws.write(rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket"), path)
        written = {int(f.rsplit("=", 1)[1]): f for f in self.ws.folders(path) if "bucket=" in f}
        self.ws.drop_paths([self.folders[b] for b in written if b in self.folders])
        self.ws.drop(new)
        self.folders |= written
        self.epoch = epoch

    def replace(self, batch: DataFrame, epoch: int) -> None:
        """Rows of the batch take the place of those of equal keys."""
        self.upsert(batch, epoch, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new))
