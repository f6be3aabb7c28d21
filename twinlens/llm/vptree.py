"""The most similar vectors of every vector, by vantage-point trees (problem 5).

Vantage points are a hashed sample of the vectors, twice the square root of their number and at most
MAX_PIVOTS. Every vector belongs to the cell of its nearest vantage point; cells of about SHARD_ROWS vectors together form
a shard, and a larger cell is divided over several. In a shard each cell is a vantage-point tree. A vector looks for its
neighbours in its own shard, where it lies anyway, and is sent only to those other shards that hold a cell it may reach.

All pruning is by the triangle inequality with the search radius relaxed by one factor: with d the distance to a
vantage point and r the radius, a cell is left out if d exceeds the distance to the nearest vantage point by more than
2 * relax * r (unless it lies within r), and a subtree if d lies farther than relax * r from all its vectors. With ``relax`` 1 the search is exact; smaller
values prune more. The radius starts at the distance of the least similarity asked for; inside a tree it shrinks to that of the
k-th best found. Queries walk a tree in blocks, so that every step is a matrix product.

Distances are chords between unit vectors, so they order like cosines. What single precision
finds is scored again in double precision, rounded to six decimals, ties to the lesser id. As ties go to
the lesser id, of equal vectors only the k + 1 of least ids can ever be found. Where very many are equal, only those take part,
and what the last of them finds, which is itself in no such list, is the answer for all the others.

Defined cases: vectors that are null, of a wrong length, all zero or with a null, NaN or
infinite element take no part, nor do vectors of unknown kinds or without an id; equal vectors are
neighbours with similarity 1; repeated rows of one id and kind count once, before the search, and of
different vectors of one id the least stands; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.llm.textcodes import mix64
from twinlens.workspace import Workspace

# The length of the vectors of each kind.
LENGTHS = {"classical-descriptor": 368, "clip:ViT-B-32": 512}
SHARD_ROWS = 16_384
#: Vantage points at most: the size of what is collected and broadcast.
MAX_PIVOTS = 16_384
QUERY_BLOCK = 2048
LEAF_ROWS = 1024
#: Share of the search radius that the pruning rule respects; 1 is exact.
RELAX = 0.06
#: Single-precision slack on a cosine and on a distance.
SLACK = 2e-5
SLACK_CHORD = 1e-3


class VpTree:
    """A tree over the rows of ``unit`` (float32, unit length); rows are reordered so that leaves are slices."""

    def __init__(self, unit: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(unit))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(7)
        self.root = self._build(unit, 0, len(unit), leaf_rows, rng)
        self.rows = np.ascontiguousarray(unit[self.order])
        self.visited = 0

    def _build(self, unit, lo, hi, leaf_rows, rng) -> int:
        at = len(self.nodes)
        if hi - lo <= leaf_rows:
            self.nodes.append((lo, hi))
            return at
        part = self.order[lo:hi]
        # of a few rows, the vantage point with the widest spread of distances
        tries = unit[part[rng.integers(0, len(part), 8)]]
        probe = unit[part[rng.integers(0, len(part), min(len(part), 512))]]
        vantage = tries[np.argmax(np.var(_chord(probe @ tries.T), axis=0))]
        d = _chord(unit[part] @ vantage)
        by = np.argsort(d, kind="stable")
        self.order[lo:hi] = part[by]
        d = d[by]
        mid = (hi - lo) // 2
        self.nodes.append(())
        left = self._build(unit, lo, lo + mid, leaf_rows, rng)
        right = self._build(unit, lo + mid, hi, leaf_rows, rng)
        self.nodes[at] = (vantage, (left, d[0], d[mid - 1]), (right, d[mid], d[-1]))
        return at

    def search(self, queries: np.ndarray, best: np.ndarray, who: np.ndarray, relax: float) -> list[tuple[np.ndarray, ...]]:
        """(query, row, cosine) of all rows that were among the best of the queries ``who`` when met. ``best`` holds the
        best cosines of each query, the least of them first, and is brought up to date."""
        self._q, self._best, self._relax, self._found = queries, best, relax, []
        self._walk(self.root, who)
        return [(q, self.order[r], s) for q, r, s in self._found]

    def _walk(self, at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        node = self.nodes[at]
        if len(node) == 2:
            lo, hi = node
            self.visited += len(who) * (hi - lo)
            sims = self._q[who] @ self.rows[lo:hi].T
            q, r = np.nonzero(sims >= (self._best[who, 0] - SLACK)[:, None])
            if not len(q):
                return
            self._found.append((who[q], r + lo, sims[q, r]))
            some = np.unique(q)
            k = self._best.shape[1]
            both = np.concatenate((self._best[who[some]], sims[some]), axis=1)
            self._best[who[some]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            return
        vantage, *sides = node
        d = _chord(self._q[who] @ vantage)
        near_left = d <= (sides[0][2] + sides[1][1]) / 2
        for side, first in ((0, near_left), (1, ~near_left), (0, ~near_left), (1, near_left)):
            child, least, most = sides[side]
            sub = who[first]
            if not len(sub):
                continue
            reach = self._relax * _chord(self._best[sub, 0]) + SLACK_CHORD
            x = d[first]
            self._walk(child, sub[(x - reach <= most) & (x + reach >= least)])


def _chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0))


def _matrix(col: pa.Array) -> np.ndarray:
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(len(col), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    u = vectors.astype(np.float64)
    return u / np.linalg.norm(u, axis=1)[:, None]


class Layout:
    """Vantage points of each kind, the shards of their cells, and the rule which shards a vector may reach."""

    def __init__(self, pivots: dict[int, np.ndarray], min_cos: float, relax: float):
        self.pivots = pivots
        self.radius = float(_chord(np.float64(min_cos - SLACK)))
        self.slack = 2 * relax * self.radius + SLACK_CHORD
        self.shards = 0

    def deal(self, counts: dict[tuple[int, int], int], shard_rows: int) -> Layout:
        """Cells one after the other into shards; a cell above ``shard_rows`` gets several of its own."""
        self.first, self.parts = {}, {}
        for kind, pivots in self.pivots.items():
            first, parts = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64)
            held = shard_rows
            for cell in range(len(pivots)):
                n = counts.get((kind, cell), 0)
                if n > shard_rows:
                    parts[cell] = -(-n // shard_rows)
                    first[cell], self.shards, held = self.shards, self.shards + int(parts[cell]), shard_rows
                    continue
                if held + n > shard_rows:
                    self.shards, held = self.shards + 1, 0
                first[cell], held = self.shards - 1, held + n
            self.first[kind], self.parts[kind] = first, parts
        return self

    def distances(self, kind: int, unit: np.ndarray) -> np.ndarray:
        return _chord(unit @ self.pivots[kind].T)

    def reached(self, d: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """Which cells a vector may reach, from its distances to their vantage points and the least to any."""
        return d <= np.maximum(nearest + self.slack, self.radius)[:, None]


def _by_kind(b: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of one kind and at most ``rows`` rows; columns id, kind, vector."""
    kinds = b.column(1).to_numpy()
    for kind in np.unique(kinds):
        part = b.filter(pa.array(kinds == kind))
        for at in range(0, part.num_rows, rows):
            yield int(kind), part.slice(at, rows)


def _home_cells(layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, p in _by_kind(b, 1024):
                home = layout.value.distances(kind, _unit(_matrix(p.column(2))).astype(np.float32)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home), kind, dtype=np.int32)), pa.array(home.astype(np.int32))], names=["kind", "cell"])

    return run


ROUTED = "shard int, role int, id bigint, kind int, cell int, nearest float, vector array<float>"


def _route(layout):
    """Each vector to its own shard (role 0) and to the others it may reach (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay: Layout = layout.value
        for b in batches:
            for kind, p in _by_kind(b, 1024):
                ids = p.column(0).to_numpy()
                d = lay.distances(kind, _unit(_matrix(p.column(2))).astype(np.float32))
                home = d.argmin(axis=1)
                nearest = d[np.arange(len(d)), home]
                first, parts = lay.first[kind], lay.parts[kind]
                part = (mix64(ids.view(np.uint64)) % parts[home].astype(np.uint64)).astype(np.int64)
                own = first[home] + part
                to = np.zeros((len(ids), lay.shards), dtype=bool)
                row, cell = np.nonzero(lay.reached(d, nearest))
                to[row, first[cell]] = True
                many = parts[cell] > 1
                for c in np.unique(cell[many]):
                    to[row[cell == c], first[c] : first[c] + parts[c]] = True
                to[np.arange(len(ids)), own] = False
                row, shard = np.nonzero(to)
                row, shard = np.concatenate((np.arange(len(ids)), row)), np.concatenate((own, shard))
                role = (np.arange(len(row)) >= len(ids)).astype(np.int32)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.astype(np.int32)),
                        pa.array(role),
                        pa.array(ids[row]),
                        pa.array(np.full(len(row), kind, dtype=np.int32)),
                        pa.array(home[row].astype(np.int32)),
                        pa.array(nearest[row]),
                        p.column(2).take(take),
                    ],
                    names=[x.split()[0] for x in ROUTED.split(", ")],
                )

    return run


class Shard:
    """The trees of the cells of one shard."""

    def __init__(self, layout: Layout, kind: int, ids: np.ndarray, cells: np.ndarray, vectors: np.ndarray, k: int, leaf_rows: int):
        # of equal vectors only the k + 1 of least ids can ever be among the k best
        flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        same = np.unique(flat, return_inverse=True)[1]
        by = np.lexsort((ids, same))
        rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        keep = np.sort(by[rank <= k])
        self.layout, self.kind, self.k = layout, kind, k
        self.ids, self.unit = ids[keep], _unit(vectors[keep])
        cells, single = cells[keep], self.unit.astype(np.float32)
        self.cells = np.unique(cells)
        self.rows = [np.flatnonzero(cells == c) for c in self.cells]
        self.trees = [VpTree(single[r], leaf_rows) for r in self.rows]

    def neighbours(self, qid: np.ndarray, vectors: np.ndarray, nearest: np.ndarray, min_cos: float, relax: float):
        """(query, neighbour, cosine) in double precision, at most k a query."""
        exact = _unit(vectors)
        q = exact.astype(np.float32)
        best = np.full((len(q), self.k + 1), np.float32(min_cos - SLACK))
        d = _chord(q @ self.layout.pivots[self.kind][self.cells].T)
        near = d.argmin(axis=1)
        reached = self.layout.reached(d, nearest)
        found = []
        # first the nearest cell of each query, to narrow its radius early
        for first in (True, False):
            for c, tree in enumerate(self.trees):
                who = np.flatnonzero(reached[:, c] & ((near == c) == first))
                if len(who):
                    found += [(a, self.rows[c][r], s) for a, r, s in tree.search(q, best, who, relax)]
        if not found:
            return qid[:0], self.ids[:0], exact[:0, 0]
        a, b, s = (np.concatenate(x) for x in zip(*found))
        keep = (s >= best[a, 0] - SLACK) & (qid[a] != self.ids[b])
        a, b = a[keep], b[keep]
        cos = np.empty(len(a))
        for at in range(0, len(a), 65_536):
            e = slice(at, at + 65_536)
            cos[e] = np.einsum("ij,ij->i", exact[a[e]], self.unit[b[e]])
        cos = np.round(cos, 6)
        good = cos >= min_cos
        a, b, cos = a[good], self.ids[b[good]], cos[good]
        by = np.lexsort((b, -cos, a))
        a, b, cos = a[by], b[by], cos[by]
        top = np.arange(len(a)) - np.searchsorted(a, a) < self.k
        return qid[a[top]], b[top], cos[top]


NEIGHBOURS = "id bigint, neighbour bigint, cosine double"


def _search(layout, k: int, min_cos: float, relax: float, leaf_rows: int):
    """Partitions sorted by shard, role and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, shard, last = None, [], None, None

        def answer(cols) -> Iterator[pa.RecordBatch]:
            ids, kind, _, nearest, vectors = cols
            for s in range(0, len(ids), QUERY_BLOCK):
                e = slice(s, s + QUERY_BLOCK)
                a, b, cos = shard.neighbours(ids[e], vectors[e], nearest[e], min_cos, relax)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(cos)], names=["kind", "id", "neighbour", "cosine"])

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            ids, cells, nearest, vectors = (np.concatenate(x) for x in zip(*((i, c, n, v) for i, _, c, n, v in kept)))
            shard = Shard(layout.value, kept[0][1], ids, cells, vectors, k, leaf_rows)
            yield from answer((ids, kept[0][1], cells, nearest, vectors))
            kept.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = shards.astype(np.int64) * 2 + roles
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                # rows of one id follow each other, also over the end of a batch; the first stands for all
                ids = part.column(2).to_numpy()
                fresh = np.concatenate(([last != (code[lo], ids[0])], ids[1:] != ids[:-1]))
                last = code[lo], ids[-1]
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                if shards[lo] != at:
                    if kept:
                        yield from build()
                    at, shard = shards[lo], None
                cols = (part.column(2).to_numpy(), int(part.column(3)[0].as_py()), part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6)))
                if roles[lo] == 0:
                    kept.append(cols)
                    continue
                if kept:
                    yield from build()
                if shard is not None:
                    yield from answer(cols)
        if kept:
            yield from build()

    return run


def usable_vectors(df: DataFrame, lengths: dict[str, int] = LENGTHS) -> DataFrame:
    """(id, kind, vector) of the vectors that can take part; kind counts the keys of ``lengths``."""
    kind, length = F.lit(None).cast("int"), F.lit(-1)
    for i, (name, n) in enumerate(lengths.items()):
        kind = F.when(F.col("backend") == name, F.lit(i)).otherwise(kind)
        length = F.when(F.col("backend") == name, F.lit(n)).otherwise(length)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col("vec_id").cast("bigint").alias("id"), kind.alias("kind"), length.alias("length"), F.col("vector").cast("array<float>").alias("vector"))
        .where("id IS NOT NULL AND kind IS NOT NULL AND size(vector) = length")
        .where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
        .select("id", "kind", "vector")
    )


def choose_pivots(rows: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Vantage points of each kind: the vectors whose ids have the least hashes, a number of them that grows with
    the square root of the collection up to MAX_PIVOTS."""
    out = {}
    for kind, n in counts.items():
        m = min(n, MAX_PIVOTS, 2 * ceil(sqrt(n)))
        mark = F.xxhash64("id", F.lit(17))
        some = rows.where((F.col("kind") == kind) & (F.pmod(mark, F.lit(n)) <= 2 * m)).select(mark.alias("h"), "id", "vector")
        got = some.dropDuplicates(["h", "id"]).orderBy("h", "id").limit(m).select("vector").collect() or rows.where(F.col("kind") == kind).select("vector").limit(1).collect()
        out[kind] = _unit(np.unique(np.array([r["vector"] for r in got], dtype=np.float32), axis=0)).astype(np.float32)
    return out


#: Copies of a vector from which on only the least ids take part.
MANY_COPIES = 1024
#: Vectors at most that are treated so, the most frequent first.
MOST_COPIED = 2_000


def much_copied(rows: DataFrame, many: int) -> list[tuple[int, int]]:
    """(kind, hash) of the vectors with more than ``many`` copies; hashes that different vectors share are left out."""
    by_hash = rows.groupBy("kind", F.xxhash64("vector").alias("h")).agg(F.count("*").alias("n"))
    top = by_hash.where(F.col("n") > many).orderBy(F.desc("n"), "kind", "h").limit(MOST_COPIED).select("kind", "h").collect()
    if not top:
        return []
    listed = F.broadcast(rows.sparkSession.createDataFrame(top, "kind int, h bigint"))
    same = rows.withColumn("h", F.xxhash64("vector")).join(listed, ["kind", "h"]).groupBy("kind", "h").agg(F.min("vector").alias("a"), F.max("vector").alias("b"))
    return [(r["kind"], r["h"]) for r in same.where("a = b").select("kind", "h").collect()]


def nearest_neighbours(
    df: DataFrame,
    k: int = 10,
    min_cos: float = 0.8,
    relax: float = RELAX,
    lengths: dict[str, int] = LENGTHS,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
    many_copies: int = MANY_COPIES,
) -> DataFrame:
    """(id, neighbour, cosine): the k most similar other vectors of each, as far as above ``min_cos``."""
    spark = df.sparkSession
    rows = usable_vectors(df, lengths)
    h = F.xxhash64("vector")
    clashes = rows.groupBy("kind", "id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b")
    if not clashes.isEmpty():  # different vectors of one id
        rows = rows.groupBy("kind", "id").agg(F.min("vector").alias("vector")).select("id", "kind", "vector")
    copied = much_copied(rows, max(many_copies, k + 1))
    if not copied:
        return _search_all(rows, k, min_cos, relax, shard_rows, leaf_rows).select("id", "neighbour", "cosine")
    listed = F.broadcast(spark.createDataFrame(copied, "kind int, h bigint"))
    marked = rows.withColumn("h", h)
    ids = marked.select("kind", "h", "id").join(listed, ["kind", "h"]).distinct()
    least = ids.withColumn("place", F.row_number().over(Window.partitionBy("kind", "h").orderBy("id"))).where(F.col("place") <= k + 1)
    least = Workspace(spark, "vectors").save(least, "least")  # at most k + 1 for each vector listed
    stay = F.broadcast(least.select("kind", "id"))
    part = marked.join(listed, ["kind", "h"], "left_anti").select("id", "kind", "vector").unionByName(
        rows.join(stay, ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"]).select("id", "kind", "vector")  # of one id all are equal
    )
    found = Workspace(spark, "vectors").save(_search_all(part, k, min_cos, relax, shard_rows, leaf_rows), "found")
    last = least.where(F.col("place") == k + 1).select("kind", "h", F.col("id").alias("last"))
    answer = found.join(F.broadcast(last), (found["kind"] == last["kind"]) & (found["id"] == last["last"])).select(last["kind"], "h", "neighbour", "cosine")
    others = ids.join(stay, ["kind", "id"], "left_anti").join(F.broadcast(answer), ["kind", "h"])
    return found.select("id", "neighbour", "cosine").unionByName(others.select("id", "neighbour", "cosine"))


def _search_all(rows: DataFrame, k: int, min_cos: float, relax: float, shard_rows: int, leaf_rows: int) -> DataFrame:
    """(kind, id, neighbour, cosine) of usable vectors."""
    spark = rows.sparkSession
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "kind int, " + NEIGHBOURS)
    layout = Layout(choose_pivots(rows, counts), min_cos, relax)
    plain = spark.sparkContext.broadcast(layout)
    sizes = rows.mapInArrow(_home_cells(plain), "kind int, cell int").groupBy("kind", "cell").count().collect()
    layout.deal({(r["kind"], r["cell"]): r["count"] for r in sizes}, shard_rows)
    dealt = spark.sparkContext.broadcast(layout)
    found = (
        rows.mapInArrow(_route(dealt), ROUTED)
        .repartitionById(layout.shards, F.col("shard"))
        .sortWithinPartitions("shard", "role", "id")
        .mapInArrow(_search(dealt, k, min_cos, relax, leaf_rows), "kind int, " + NEIGHBOURS)
    )
    best = Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def neighbour_pairs(df: DataFrame, **how) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of which one is among the most similar of the other."""
    near = nearest_neighbours(df, **how)
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()
