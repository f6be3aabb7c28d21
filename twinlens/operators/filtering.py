"""The candidate filter: hash gate, colour rescue, cap and safety net."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.config import CLASSIFIER, FILTER
from twinlens.operators.ranking import spread_rank

#: Steps into which similarities are divided for ranking.
STEPS = 4096


def usable(error: Column, sha: Column, hashes: list[Column]) -> Column:
    """Whether a candidate has an image and all of its fingerprints (P5)."""
    return reduce(lambda a, b: a & b, [error.isNull(), sha.isNotNull(), *(h.isNotNull() for h in hashes)])


def gate(fused: Column, color: Column) -> Column:
    return (fused >= FILTER.keep_hash_sim) | rescue(fused, color)


def rescue(fused: Column, color: Column) -> Column:
    return (color >= FILTER.rescue_color_sim) & (fused >= FILTER.rescue_hash_sim)


def filter_candidates(scored: DataFrame, query: str, order: str = "seq") -> DataFrame:
    """Adds ``rank``, ``decided`` (what the decision row says), ``reason`` and ``kept`` (whether the row goes on).

    ``scored`` has fused, color and ok; rows that aren't ok are never ranked and carry their error.
    The gate's rows are taken by rank up to the cap; then the best of all fill up. Rows of a query are ranked by steps of
    similarity, so that a query with a large share of all rows isn't sorted in one task.
    """
    fused, color = F.col("fused"), F.col("color")
    passing = F.coalesce(gate(fused, color), F.lit(False))
    step = -F.floor(F.coalesce(fused, F.lit(-1.0)) * STEPS)
    ranked = spread_rank(
        scored.where("ok").withColumn("__gate", passing.cast("int")),
        [query],
        step,
        [F.desc("fused"), F.desc("color"), F.col(order)],
        "rank",
        {"__before": F.col("__gate")},
    ).withColumnRenamed("total___before", "__passing")
    bad = scored.where("not coalesce(ok, false)").withColumns({c: F.lit(None).cast("bigint") for c in ("rank", "__before", "__passing")} | {"__gate": F.lit(0)})
    ranked = ranked.unionByName(bad.select(*ranked.columns))
    gated = F.col("__gate") == 1
    cap, top = FILTER.hard_cap, FILTER.keep_top_n
    by_gate = gated & (F.col("__before") <= cap)
    by_net = F.col("ok") & ~gated & (F.col("rank") <= top) & (F.least(F.col("__passing"), F.lit(cap)) + F.col("rank") - F.col("__before") <= cap)
    reason = (
        F.when(~F.col("ok"), F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("undecodable")))
        .when(by_net, f"kept by top-{top} safety net")
        .when(fused >= FILTER.keep_hash_sim, "hash similarity above threshold")
        .when(rescue(fused, color), "colour-palette rescue (possible crop)")
        .otherwise(F.format_string(f"hash similarity %.3f below {FILTER.keep_hash_sim}", fused))
    )
    kept = F.coalesce(by_gate | by_net, F.lit(False))
    return ranked.withColumns({"reason": reason, "kept": kept, "decided": F.coalesce(gated | by_net, F.lit(False))}).drop("__gate", "__before", "__passing")


def promising(identity: Column) -> Column:
    """Whether a provisional identity earns the deep check."""
    return identity >= CLASSIFIER.identity_similar * CLASSIFIER.promote_share
