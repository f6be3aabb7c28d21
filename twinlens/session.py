"""Session defaults and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "twinlens", master: str | None = None, shared_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume; values given in ``conf`` win. ``shared_dir`` is the folder that all
    executors share, for intermediate tables; a cluster needs one."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shared_dir:
        defaults["spark.checkpoint.dir"] = shared_dir
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
