"""Merging verified candidates into cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.config import CLASSIFIER, PIXEL
from twinlens.operators.components import connected_components
from twinlens.operators.skew import salted_join

BAND = 0.05
ONE_TO_ONE = ("EXACT_1TO1", "NEAR_1TO1", "EDITED_1TO1")
MERGED = (*ONE_TO_ONE, "CROP")


def same_picture(identity: Column, changed: Column, edits: Column) -> Column:
    """Whether a quick comparison shows one rendered image."""
    return (identity >= CLASSIFIER.identity_exact) & (changed <= PIXEL.changed_exact) & (F.size(edits) == 0)


def pairs_within(df: DataFrame, label: str, cid: str, keep: list[str]) -> DataFrame:
    """Pairs cid_a < cid_b of equal label; columns in ``keep`` come from both, suffixed _a and _b."""
    a = df.select(F.col(label).alias("label"), *(F.col(c).alias(f"{c}_a") for c in [cid, *keep]))
    b = df.select(F.col(label).alias("label"), *(F.col(c).alias(f"{c}_b") for c in [cid, *keep]))
    return a.join(b, "label").where(F.col(f"{cid}_a") < F.col(f"{cid}_b"))


def band_pairs(df: DataFrame, key: list[str], value: str, cid: str, width: float = BAND) -> DataFrame:
    """Pairs of equal key whose values differ by at most ``width``: values are put into bands of that
    width, one side looks into three, and the exact condition decides. An equi-join, not a nested loop."""
    # a little wider than the condition, so that rounding can't put partners two bands apart
    rows = df.where(F.col(value).isNotNull()).withColumn("__band", F.floor(F.col(value) / (width * 1.001)))
    a = rows.select(*key, F.explode(F.array(*(F.col("__band") + i for i in (-1, 0, 1)))).alias("__band"), F.col(cid).alias("cid_a"), F.col(value).alias("value_a"))
    b = rows.select(*key, "__band", F.col(cid).alias("cid_b"), F.col(value).alias("value_b"))
    near = F.round(F.abs(F.col("value_a") - F.col("value_b")), 9) <= width
    return a.join(b, [*key, "__band"]).where((F.col("cid_a") < F.col("cid_b")) & near).drop("__band")


def pairs_to_compare(verdicts: DataFrame, width: float = BAND) -> DataFrame:
    """(cid_a, cid_b, same_bytes), cid_a < cid_b: candidates of one query and label that may be one picture. Equal bytes are
    linked to the least of them without a comparison, and only that one is compared with others; crops only with crops of
    nearly equal overlap. ``verdicts`` has query_id, label, cid, overlap, sha256; a query's candidates are few, as the
    filter caps them."""
    open_ = verdicts.where(F.col("label").isin(*MERGED))
    key = F.when(F.col("sha256") != "", F.col("sha256")).otherwise(F.concat(F.lit("cid "), "cid"))
    first = open_.groupBy("query_id", "label", key.alias("bytes")).agg(F.min("cid").alias("cid_a"), F.min_by("overlap", "cid").alias("overlap"))
    alike = open_.withColumn("bytes", key).join(first.drop("overlap"), ["query_id", "label", "bytes"]).where("cid <> cid_a")
    first = first.withColumnRenamed("cid_a", "cid")
    whole = pairs_within(first.where(F.col("label") != "CROP").withColumn("__k", F.struct("query_id", "label")), "__k", "cid", [])
    crops = band_pairs(first.where("label = 'CROP'"), ["query_id"], "overlap", "cid", width)
    compare = whole.select("cid_a", "cid_b").unionAll(crops.select("cid_a", "cid_b")).withColumn("same_bytes", F.lit(False))
    return compare.unionByName(alike.select("cid_a", F.col("cid").alias("cid_b"), F.lit(True).alias("same_bytes")))


def clusters(members: DataFrame, edges: DataFrame, cid: str = "cid") -> DataFrame:
    """(cid, cluster): members linked by edges get the least cid of their component, all others their own."""
    comp = connected_components(edges, "cid_a", "cid_b")
    return members.join(comp, members[cid] == comp["node"], "left").select(members[cid], F.coalesce("component", members[cid]).alias("cluster"))


def representative(df: DataFrame, cluster: list[str], order: str) -> DataFrame:
    """The member with the most pixels of each cluster, the first on a tie."""
    area = F.coalesce(F.col("width").cast("bigint") * F.col("height"), F.lit(0))
    best = F.struct((-area).alias("__area"), F.col(order).alias("__order"))
    return df.groupBy(*cluster).agg(F.min_by(F.struct("cid", "url", "width", "height"), best).alias("__r"), F.count("*").alias("members")).select(*cluster, "__r.*", "members")


def same_bytes(own: DataFrame, members: DataFrame, sha: str, spread: Column) -> DataFrame:
    """``own`` joined with all ``members`` of equal bytes; bytes that very many members share are spread over tasks."""
    n = members.groupBy(sha).agg(F.count("*").alias("__n"))
    return salted_join(members, own.join(n.hint("merge"), sha), sha, "__n", spread, weights=n).drop("__n")


def ordered_distinct(value: str, order: str) -> Column:
    """Distinct non-empty values by first appearance, as an aggregate."""
    pairs = F.collect_list(F.when(F.col(value).isNotNull() & (F.col(value) != ""), F.struct(F.col(order), F.col(value))))
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda s: s[value]))


def attach_aliases(cards: DataFrame, aliases: DataFrame, url: Column, card_order: Column) -> DataFrame:
    """(card_key and the alias columns) of aliases whose canonical address belongs to a card; of several
    cards the last one. ``cards`` has card_key and canon; aliases without a card are dropped."""
    owner = cards.groupBy("canon").agg(F.max_by("card_key", card_order).alias("card_key"))
    return aliases.withColumn("canon", url).join(owner, "canon")
