"""Tables written to the folder that every executor shares.

Iterative operators cut their lineage by writing a table there and reading it back: the
result survives the loss of any executor, which a local checkpoint does not.

What is written is removed as soon as an operator knows that nothing will read it again. What a result
still reads stays until ``release`` is called, or until the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LIVE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its
    own; on a cluster that is an error, as executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="twinlens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all that workspaces still hold; results made before can't be read afterwards."""
    while _LIVE:
        _delete(spark, _LIVE.pop())


class Workspace:
    """A private subfolder of the shared folder; each ``save`` writes one table."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        if not self._n:
            _LIVE.add(self.root)
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def write(self, writer: DataFrameWriter, path: str) -> None:
        """Write a table. Nothing reads the shuffle files of a write again, so Spark deletes them when it is done; else they
        would stay until the driver's JVM collects the plan."""
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back, with the same schema."""
        path = self.path(name)
        self.write(df.write, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._twinlens_path = path
        return out

    def folders(self, path: str) -> list[str]:
        """The folders directly below a path, such as those of a table's partitions."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []

    def drop_paths(self, paths: list[str]) -> None:
        for path in paths:
            _delete(self.spark, path)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables written by ``save`` that nothing will read again."""
        for table in tables:
            path = getattr(table, "_twinlens_path", None)
            if path:
                _delete(self.spark, path)
