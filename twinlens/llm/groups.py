"""Consolidating pairwise matches into groups (problem 4).

Minimum labels are propagated across the edges: each round every record takes the least label among
its neighbours, chains of labels are shortened by pointer jumping until no label changes, and edges are renamed to the
labels of their ends, dropping those whose ends agree. Labels and edges are written to the shared folder each
time. When no edge is left, the labels of all rounds are put together, from the last one back, and each record's label is the
least identifier of its group. Rounds and jumps are logarithmic in the records; labels that very many records share
are met by salted joins.

Defined cases: an edge with a null end links nothing; an edge from a record to itself or
given again changes nothing; a list links all its members (null members are left out), and one
of a single member links nothing; records without a link have no row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators.components import contract, jump, put_together, undirected
from twinlens.workspace import Workspace


def list_edges(df: DataFrame, members: str) -> DataFrame:
    """Edges (a, b) from the least member of each list to every other: a star, not all pairs."""
    return (
        df.select(F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull())).alias("m"))
        .where("size(m) > 1")
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a <> b")
    )


def group_records(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, group): every record named by an edge with the least identifier of its group."""
    ws = Workspace(edges.sparkSession, "groups")
    live, rounds = ws.save(undirected(edges, a, b), "edges"), []
    edges_left = most = live.count()
    while edges_left:
        # propagate: the least neighbour of every record that has a lesser one, then the root of its chain
        least = ws.save(live.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("label")), "labels")
        rounds.append(jump(ws, least, edges_left))
        before, live = live, ws.save(contract(live, rounds[-1], edges_left), "edges")
        ws.drop(before)
        edges_left = live.count()
    labels = put_together(ws, rounds, most)
    if labels is None:
        return live.select(F.col("x").alias("member"), F.col("y").alias("group"))
    roots = labels.select(F.col("label").alias("v"), "label").distinct()
    return labels.unionByName(roots).select(F.col("v").alias("member"), F.col("label").alias("group"))


def candidate_groups(match_pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """(group_cid, cid) of every candidate linked by a decided match or a shared card."""
    pairs = match_pairs.where("is_match").select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    linked = group_records(pairs.unionByName(list_edges(cards, "member_cids")))
    return linked.select(F.col("group").alias("group_cid"), F.col("member").alias("cid"))
