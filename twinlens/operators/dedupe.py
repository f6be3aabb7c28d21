"""First-wins deduplication and numbering.

Order is never implied: each operator takes the columns that order the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.config import LIMITS
from twinlens.operators.skew import salted_join


def first_per_key(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, by aggregation: partial results before the shuffle, so a hot key
    costs one row a partition. Null keys form a key of their own; ties keep one row."""
    keys = {f"__k{i}": k for i, k in enumerate(key)}
    rank = {f"__o{i}": o for i, o in enumerate(order)}
    wide = df.select(*(v.alias(k) for k, v in keys.items()), F.struct(*(v.alias(k) for k, v in rank.items())).alias("__o"), F.struct(*df.columns).alias("__row"))
    return wide.groupBy(*keys).agg(F.min_by("__row", "__o").alias("__row")).select("__row.*")


def unique_and_aliases(df: DataFrame, key: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, all later rows). The first place of a key is found by partial aggregation
    and brought back by a salted join, so a key with very many rows isn't ranked in one task. ``order``
    must be unique within a key: rows tied for the first place all count as first. Null is a key."""
    tagged = df.withColumns({"__key": F.struct(key.alias("k")), "__order": F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))})
    firsts = tagged.groupBy("__key").agg(F.min("__order").alias("__first"), F.count("*").alias("__n"))
    marked = salted_join(tagged, firsts, "__key", "__n", F.col("__order"))
    return (marked.where(test).select(*df.columns) for test in ("__order = __first", "__order > __first"))


def content_groups(df: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """Byte-identical groups: key, copies and the columns of the first row; rows without a key are left out."""
    return (
        df.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.count("*").alias("copies"), F.min_by(F.struct(*keep), order).alias("__first"))
        .select(key, "copies", "__first.*")
    )


def limit_per_query(df: DataFrame, query: str, order: list[Column], n: int = LIMITS.max_candidates) -> DataFrame:
    """The first ``n`` rows of each query; the planner keeps n a task before the shuffle."""
    r = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return df.withColumn("__rank", r).where(F.col("__rank") <= n).drop("__rank")


def number_candidates(df: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """``cid`` c00000, c00001, ... in order within each query."""
    r = F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1
    return df.withColumn("cid", F.format_string("c%05d", r))
