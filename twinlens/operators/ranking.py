"""Exact ranks without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread_rank(df: DataFrame, group: list[str], step: Column, order: list[Column], rank: str, running: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``rank``, the row number within its group by ``step`` and then ``order``.

    ``step`` is a whole number that grows with the order, such as a rounded score. Only rows of one step of one group are
    sorted together; counts by step, a row a step, say how many come before. ``running`` gives sums up to and including each
    row by name, and ``total_<name>`` over the group. Null groups are groups.
    """
    running = running or {}
    rows = df.withColumns({"__group": F.struct(*group), "__step": step})
    per = rows.groupBy("__group", "__step").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{k}") for k, c in running.items()))
    before = Window.partitionBy("__group").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__group")
    none = F.lit(0)
    offsets = per.select(
        "__group",
        "__step",
        F.coalesce(F.sum("__n").over(before), none).alias("__n0"),
        *(F.coalesce(F.sum(f"__{k}").over(before), none).alias(f"__{k}0") for k in running),
        *(F.sum(f"__{k}").over(whole).alias(f"total_{k}") for k in running),
    )
    w = Window.partitionBy("__group", "__step").orderBy(*order)
    out = rows.join(offsets.hint("merge"), ["__group", "__step"])
    sums = {k: F.col(f"__{k}0") + F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in running.items()}
    out = out.withColumns({rank: F.col("__n0") + F.row_number().over(w)} | sums)
    return out.drop("__group", "__step", "__n0", *(f"__{k}0" for k in running))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], step: Column) -> DataFrame:
    """(group and a column for each of ``shares``): exact percentiles, interpolated between neighbours, without bringing the
    values of a group together. ``step`` grows with the value."""
    ranked = spread_rank(df.where(F.col(value).isNotNull()), [group], step, [F.col(value)], "__rank", {"__rows": F.lit(1)})
    n = F.col("total___rows")

    def at(share: float, side) -> Column:
        return F.max(F.when(F.col("__rank") == side((n - 1) * share + 1), F.col(value).cast("double")))

    ends = ranked.groupBy(group).agg(F.max(n).alias("__n"), *(at(q, side).alias(f"__{name}_{k}") for name, q in shares.items() for k, side in (("lo", F.floor), ("hi", F.ceil))))

    def between(name: str, share: float) -> Column:
        place = (F.col("__n") - 1) * share
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return lo + (hi - lo) * (place - F.floor(place))

    return ends.select(group, *(between(k, q).alias(k) for k, q in shares.items()))
