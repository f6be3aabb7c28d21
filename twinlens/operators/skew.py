"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this on the large side may be spread over SALTS tasks.
HOT_ROWS = 50_000
SALTS = 32
#: Keys spread at most: a key that isn't among the most frequent has less than 1 / MOST_HOT of all rows.
MOST_HOT = 2_000


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` with ``per_key`` (one row a key, ``weight`` = the key's rows) on ``key``.

    The MOST_HOT most frequent keys above ``hot_rows`` are replicated ``salts`` times on the small
    side and spread over ``spread`` on the large one. Only their list is broadcast, so its size has a fixed
    bound; the join itself is by merging, whatever the sizes. ``weights`` (key and weight) may be given where it takes
    less to make than ``per_key``. Null keys match nothing.
    """
    hot = (per_key if weights is None else weights).where(F.col(weight) > hot_rows).orderBy(F.desc(weight), key).limit(MOST_HOT).select(F.col(key), F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    keyed = per_key.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(salt)).drop("__hot")
    big = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    )
    return big.drop("__hot").join(keyed.hint("merge"), [key, "__salt"], how).drop("__salt")
