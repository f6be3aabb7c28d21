"""Counters, groups and final order of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.config import UNKNOWN_RANK
from twinlens.functions.urls import host
from twinlens.operators.ranking import spread_rank


def card_counts(cards: DataFrame) -> DataFrame:
    """Cards by class, in one row."""
    lab = F.col("label")
    return cards.agg(
        F.count("*").alias("merged_cards"),
        F.count_if(lab.isin("EXACT_1TO1", "NEAR_1TO1", "EDITED_1TO1")).alias("one_to_one"),
        F.count_if(lab == "CROP").alias("crops"),
        F.count_if(lab == "VISUALLY_SIMILAR").alias("similar"),
        F.count_if(lab.isin("UNRELATED", "ERROR")).alias("unrelated"),
    )


def final_order() -> list[Column]:
    """Sort columns for cards joined to the label dimension."""
    return [F.coalesce("group_rank", F.lit(UNKNOWN_RANK)), F.desc("confidence"), F.col("card_key")]


def report_positions(cards: DataFrame, run: str) -> DataFrame:
    """Adds ``position``: the place of each card in the report of its run. Confidence is a number up to 100."""
    step = F.coalesce("group_rank", F.lit(UNKNOWN_RANK)) * 1000 - F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("confidence", F.lit(0.0)))) * 9)
    return spread_rank(cards, [run], step, final_order(), "position")


def cards_by_group(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """Each group's title with the cards it lists, a row a card: group, its rank and title, the place within the group."""
    dim = labels.select("group_name", "group_rank", "title").distinct()
    named = cards.drop("group_rank", "title").join(F.broadcast(dim), "group_name", "left").withColumn("group_rank", F.coalesce("group_rank", F.lit(UNKNOWN_RANK)))
    step = -F.floor(F.coalesce("confidence", F.lit(0.0)) * 9)
    return spread_rank(named, ["run_id", "group_name"], step, [F.desc("confidence"), F.col("card_key")], "place")


def report_groups(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """Group, title and number of cards, in report order; groups without cards don't appear."""
    dim = labels.select("group_name", "group_rank", "title").distinct()
    counted = cards.groupBy("group_name").agg(F.count("*").alias("cards"), F.max("confidence").alias("best_confidence"))
    return counted.join(F.broadcast(dim), "group_name", "left").withColumn("group_rank", F.coalesce("group_rank", F.lit(UNKNOWN_RANK)))


def confusion(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected against actual labels with counts."""
    return actual.join(expected, key).groupBy("expected", "actual").agg(F.count("*").alias("n"))


def engine_outcomes(hits: DataFrame, engines: DataFrame) -> DataFrame:
    """Hits of every engine, those without any included."""
    counted = hits.groupBy("engine").agg(F.count("*").alias("count"))
    return engines.join(counted, "engine", "left").select("engine", "display_name", F.coalesce("count", F.lit(0)).alias("count"))


def select_engines(engines: DataFrame, names: list[str] | None) -> DataFrame:
    """The named available engines; all available ones if none is named or none of them is available."""
    free = engines.where("available")
    if not names:
        return free
    wanted = free.where(F.col("engine").isin(names))
    some = wanted.agg((F.count("*") > 0).alias("__some"))
    return free.crossJoin(F.broadcast(some)).where(~F.col("__some") | F.col("engine").isin(names)).drop("__some")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All hits of all engines; columns one of them lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: What a card of the report states, and to how many digits.
REPORT = (
    "card_key string, label string, display string, group_name string, group_rank int, confidence double, overlap double, representative_cid string, best_url string, best_width int, best_height int, "
    "member_cids array<string>, pages array<string>, engines array<string>, luma_mean double, download_ms int, stage_reached int, error string"
)
DIGITS = {"confidence": 1, "overlap": 4, "luma_mean": 2}


def to_report_json(cards: DataFrame) -> DataFrame:
    """``cards`` with ``j``, the report's text of each card: numbers rounded, nulls written out."""
    names = [f.split()[0] for f in REPORT.split(", ")]
    fields = [report_number(F.col(n), DIGITS[n]).alias(n) if n in DIGITS else F.col(n) for n in names]
    return cards.withColumn("j", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def from_report_json(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.from_json(text, REPORT).alias("c")).select("c.*")


def card_headline(cards: DataFrame) -> DataFrame:
    """Adds what the head of a card shows: the hosts of its first pages and its first engines, and how many more there are."""
    hosts = F.filter(F.transform("pages", lambda p: host(p)), lambda h: h != "")
    more = lambda c, n: F.greatest(F.size(c) - n, F.lit(0)).cast("bigint")
    return cards.withColumn("__hosts", hosts).withColumns(
        {"shown_hosts": F.slice("__hosts", 1, 4), "more_hosts": more("__hosts", 4), "shown_engines": F.slice("engines", 1, 3), "more_engines": more("engines", 3)}
    ).drop("__hosts")


def report_number(c: Column, digits: int) -> Column:
    """Rounded half to even, as the report states numbers."""
    return F.bround(c, digits)
