import glob

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlens import workspace
from twinlens.operators.components import connected_components
from twinlens.operators.skew import salted_join


def test_half_of_all_rows_under_one_key_stay_spread(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
        per = big.groupBy("k").agg(F.count("*").alias("n"))
        out = salted_join(big, per, "k", "n", F.col("id"), hot_rows=1000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2_000
        assert rows(out.agg(F.sum("n").alias("s")), "s") == [(10_000 * 10_000 + 10_000,)]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_nothing_is_left_after_release(spark):
    root = workspace.shared_dir(spark).removeprefix("file://")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a int, b int")
    assert len(rows(connected_components(pairs, "a", "b"))) == 5
    assert glob.glob(f"{root}/components-*")
    workspace.release(spark)
    assert not glob.glob(f"{root}/components-*")


class _Cluster:
    """As much of a session as the folder's name asks of it, on a cluster without one."""

    class conf:
        @staticmethod
        def get(*_):
            return None

    class sparkContext:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Unset:
                            @staticmethod
                            def isDefined():
                                return False

                        return Unset

                return Sc


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        workspace.shared_dir(_Cluster)
