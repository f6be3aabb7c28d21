"""The six stages from hits to a report, for any number of query images at once.

originals: query_id, data. hits: query_id, seq, url, engine, engine_label, page_url, title, data.
Each stage that runs Python is written to the shared folder, so it runs once and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.config import FILTER, LIMITS
from twinlens.functions import hashes as H
from twinlens.functions import urls as U
from twinlens.functions import vectors as V
from twinlens.operators import classify, dedupe, filtering, images, merge
from twinlens.schema import label_dimension
from twinlens.sources import images as formats
from twinlens.workspace import Workspace


class Report:
    """The tables of one run."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)

    def counts(self) -> DataFrame:
        """Counters by query."""
        per = lambda df, *aggs: df.groupBy("query_id").agg(*aggs)
        lab = F.col("label")
        parts = [
            per(self.hits, F.count("*").alias("raw_results")),
            per(self.prints, F.count("*").alias("unique_urls"), F.count_if(F.col("error").isNull()).alias("downloaded"), F.count_if(F.col("error").isNotNull()).alias("failed_downloads")),
            per(self.kept, F.count("*").alias("compared")),
            per(self.verified, F.count("*").alias("verified")),
            per(
                self.cards,
                F.count("*").alias("merged_cards"),
                F.count_if(lab.isin("EXACT_1TO1", "NEAR_1TO1", "EDITED_1TO1")).alias("one_to_one"),
                F.count_if(lab == "CROP").alias("crops"),
                F.count_if(lab == "VISUALLY_SIMILAR").alias("similar"),
                F.count_if(lab.isin("UNRELATED", "ERROR")).alias("unrelated"),
            ),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, "query_id", "left")
        return out.na.fill(0)


def run(originals: DataFrame, hits: DataFrame) -> Report:
    spark = originals.sparkSession
    ws = Workspace(spark, "pipeline")
    hits = ws.save(hits, "hits")
    originals = ws.save(formats.normalised(originals), "originals")
    # 1: first address wins, the others are aliases; at most so many a query
    canon = hits.withColumn("canon", U.canonical_url(F.col("url")))
    first, aliases = dedupe.unique_and_aliases(canon, F.struct("query_id", "canon"), [F.col("seq")])
    uniques = dedupe.number_candidates(dedupe.limit_per_query(first, "query_id", [F.col("seq")], LIMITS.max_candidates), "query_id", [F.col("seq")])
    uniques = ws.save(formats.normalised(uniques), "uniques")
    # 2: fingerprints; identical bytes are one
    prints = ws.save(images.fingerprints(uniques.repartition("query_id", "cid"), ["query_id", "cid"]), "prints")
    original = ws.save(images.fingerprints(originals, ["query_id"]), "original")
    ok = prints.where("error IS NULL")
    content = dedupe.first_per_key(ok, [F.col("query_id"), F.col("sha256")], [F.col("cid")])
    # 3: cheap gate against the original
    o = original.where("error IS NULL").select("query_id", F.struct("sha256", "color_hist", *H.ORDER).alias("o"))
    pairs = content.join(o, "query_id")
    got = H.compare({h: F.col("o")[h] for h in H.ORDER}, {h: F.col(h) for h in H.ORDER})
    scored = pairs.select(
        "query_id", "cid", "sha256", "width", "height", F.col("o.sha256").alias("o_sha"), F.lit(True).alias("ok"), "error",
        got["fused"].alias("fused"), V.histogram_cosine(F.col("color_hist"), F.col("o.color_hist")).alias("color"),
    )
    decisions = ws.save(filtering.filter_candidates(scored, "query_id", "cid"), "decisions")
    kept = decisions.where("kept")
    bytes_ = uniques.select("query_id", "cid", F.col("data").alias("cand"))
    both = kept.join(bytes_, ["query_id", "cid"]).join(originals.select("query_id", F.col("data").alias("orig")), "query_id")
    # 4: provisional verdict at low resolution, without geometry
    keys = ["query_id", "cid"]
    low = ws.save(images.pair_signals(both.repartition(*keys), keys, "orig", "cand", "o_sha", "sha256", False, FILTER.low_size, FILTER.compare_size), "low")
    first_look = classify.verdict_columns(low.where("error IS NULL"))
    promising = ws.save(first_look.where(filtering.promising(F.col("identity"))).select(*keys), "promising")
    # 5: all signals for the promising ones
    deep = ws.save(images.pair_signals(both.join(promising, keys).repartition(*keys), keys, "orig", "cand", "o_sha", "sha256", True, FILTER.work_size, FILTER.compare_size), "deep")
    final = classify.reasons(classify.verdict_columns(deep.where("error IS NULL")))
    rest = classify.reasons(classify.verdict_columns(low.where("error IS NULL").join(promising, keys, "left_anti")))
    verdicts = ws.save(final.unionByName(rest), "verdicts")
    # 6: one card for each rendered image
    cards = merge_cards(ws, spark, verdicts, uniques, prints, aliases, keys)
    return Report(hits=hits, uniques=uniques, prints=prints, decisions=decisions, kept=kept, verified=deep, verdicts=verdicts, cards=cards)


def merge_cards(ws: Workspace, spark: SparkSession, verdicts: DataFrame, uniques: DataFrame, prints: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters within a query and label, their representative, and all sources that led to them."""
    info = prints.select(*keys, "sha256", "width", "height").join(uniques.select(*keys, "seq", "url", "engine", "engine_label", "page_url", "canon", F.col("data").alias("img")), keys)
    v = verdicts.join(info, keys).withColumn("node", F.concat_ws("/", *keys))
    crop = F.col("label") == "CROP"
    # one summary a candidate; what goes with the pairs is a thumbnail, not the image
    short = ws.save(images.summaries(v.where(F.col("label").isin(*merge.MERGED)).select("node", "img"), ["node"], "img").where("error IS NULL").drop("error"), "summaries")
    near = merge.pairs_to_compare(v.select("query_id", "label", F.col("node").alias("cid"), "overlap", "sha256"))
    sides = [short.toDF(*(c if c == "node" else f"{side}_{c}" for c in short.columns)).withColumnRenamed("node", f"cid_{side}") for side in ("a", "b")]
    pairs = near.where("NOT same_bytes").join(sides[0], "cid_a").join(sides[1], "cid_b")
    quick = ws.save(images.quick_pairs(pairs.repartition("cid_a", "cid_b"), ["cid_a", "cid_b"], "a_", "b_"), "quick")
    alike = near.where("same_bytes").select("cid_a", "cid_b")
    edges = quick.where(merge.same_picture(F.col("identity"), F.col("changed_fraction"), F.col("edit_labels"))).select("cid_a", "cid_b").unionAll(alike)
    clusters = merge.clusters(v.select("node"), edges, "node")
    grouped = v.join(clusters, "node")
    rep = merge.representative(grouped.drop("cid").withColumn("cid", F.col("node")), ["query_id", "cluster"], "seq")
    card = grouped.join(rep.select("cluster", F.col("cid").alias("rep_node"), "members"), "cluster")
    head = card.where("node = rep_node").select("cluster", "query_id", "label", "confidence", "overlap", F.col("cid").alias("representative_cid"), F.col("url").alias("best_url"), F.col("width").alias("best_width"), F.col("height").alias("best_height"))
    # every candidate with the bytes of a member is a source, and so is every alias of its address
    shas = grouped.select("query_id", "cluster", "sha256").distinct()
    members = shas.join(info, ["query_id", "sha256"]).select("query_id", "cluster", "canon", "seq", "engine", "engine_label", "page_url")
    more = aliases.join(members.select("query_id", "canon", "cluster").distinct(), ["query_id", "canon"]).select("query_id", "cluster", "canon", "seq", "engine", "engine_label", "page_url")
    sources = members.unionByName(more).groupBy("cluster").agg(
        merge.ordered_distinct("page_url", "seq").alias("pages"), merge.ordered_distinct("engine", "seq").alias("engines"), merge.ordered_distinct("engine_label", "seq").alias("engine_labels"), F.count("*").alias("sources")
    )
    cids = grouped.groupBy("cluster").agg(F.array_sort(F.collect_list("cid")).alias("member_cids"))
    dim = label_dimension(spark).select("label", "display", "group_name", "group_rank")
    out = head.join(sources, "cluster").join(cids, "cluster").join(F.broadcast(dim), "label")
    return ws.save(out.withColumn("card_key", F.concat_ws(":", "label", "representative_cid")).drop("cluster"), "cards")
