"""The label dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlens import config

LABEL = "label string, is_one_to_one boolean, group_name string, group_rank int, display string, title string"


def label_dimension(spark: SparkSession) -> DataFrame:
    """The seven labels; a fixed size, safe to broadcast."""
    return spark.createDataFrame(config.LABELS, LABEL)
