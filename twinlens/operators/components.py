"""Connected components for cards and clusters.

Every vertex that has a lesser neighbour takes the least of them as its label; the chains of labels are shortened by
pointer jumping until each ends at a root; the edges are renamed to the roots of their ends, and those within one tree
are dropped. Each round at least halves the vertices that still have edges, so rounds are logarithmic in
their number, and long chains cost jumps, logarithmic too. All labels are put together at the end, from the last round back,
so that a round handles only what still moves. Labels of very many vertices are met by a salted join.
Everything a round makes is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.operators.skew import salted_join
from twinlens.workspace import Workspace


#: A label of more rows than this, narrow as they are, is spread over tasks; a table of fewer rows has none.
HOT_LABELS = 1_000_000


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Different edges (x, y) with x > y; null ends and loops are left out."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return ends.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()


def relabel(rows: DataFrame, col: str, to: DataFrame, spread: Column, size: int) -> DataFrame:
    """``rows``, at most ``size``, with each value of ``col`` replaced by its label in ``to`` (v, label), if it has one."""
    up = to.select(F.col("v").alias(col), F.col("label").alias("__up"))
    if size <= HOT_LABELS:
        named = rows.join(up.hint("merge"), col, "left")
    else:
        n = rows.groupBy(col).agg(F.count("*").alias("__n"))
        named = salted_join(rows, n.join(up.hint("merge"), col, "left"), col, "__n", spread, hot_rows=HOT_LABELS, weights=n)
    return named.withColumn(col, F.coalesce("__up", col)).select(*rows.columns)


def jump(ws: Workspace, to: DataFrame, size: int) -> DataFrame:
    """Shorten chains of labels until no label changes: each then is a root."""
    while True:
        far = relabel(to.select("v", "label", F.col("label").alias("was")), "label", to, F.col("v"), size)
        now = ws.save(far.select("v", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        ws.drop(to)
        to = now
        if now.where("moved").isEmpty():
            return now


def contract(edges: DataFrame, to: DataFrame, size: int) -> DataFrame:
    """The edges between the labels of their ends."""
    named = relabel(relabel(edges, "x", to, F.col("y"), size), "y", to, F.col("x"), size)
    return undirected(named, "x", "y")


def put_together(ws: Workspace, rounds: list[DataFrame], size: int) -> DataFrame | None:
    """(v, label) of all rounds, each label followed through the later ones."""
    out = None
    for to in reversed(rounds):
        own, later = to.select("v", "label"), out
        if later is None:
            out = own
            continue
        out = ws.save(relabel(own, "label", later, F.col("v"), size).unionByName(later), "labels")
        ws.drop(to, rounds[-1] if to is rounds[-2] else later)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable; nodes without an edge are not in the result."""
    ws = Workspace(edges.sparkSession, "components")
    live, rounds = ws.save(undirected(edges, a, b), "edges"), []
    edges_left = most = live.count()
    while edges_left:
        least = ws.save(live.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("label")), "labels")
        rounds.append(jump(ws, least, edges_left))
        before, live = live, ws.save(contract(live, rounds[-1], edges_left), "edges")
        ws.drop(before)
        edges_left = live.count()
    labels = put_together(ws, rounds, most)
    if labels is None:
        return live.select(F.col("x").alias("node"), F.col("y").alias("component"))
    roots = labels.select(F.col("label").alias("v"), "label").distinct()
    return labels.unionByName(roots).select(F.col("v").alias("node"), F.col("label").alias("component"))
