"""Filling containers of fixed capacity with texts sized in tokens (problem 7).

Sizes are whole numbers up to the capacity, so the corpus enters the plan as a histogram: the
number of texts of each size, at most ``capacity`` numbers whatever the corpus. The plan is made
from the histogram alone, on counts: sizes above one third of the capacity are matched first, at
most two to a container, each with the largest partner that still fits; smaller sizes, falling,
then go where the gap left is smallest (best fit). One step moves all texts of a size that go
into containers of one kind, so the plan takes a number of steps bounded by the capacity. Texts
find their place by their rank within their size; ranks come from counts a salt bucket, so no
size, however frequent, is ordered in a single task. What goes to the driver and is broadcast has bounds that don't
depend on the corpus: a count for each size and bucket, at most capacity * RANK_BUCKETS, and the plan, at most three intervals of ranks
for each size and each gap that a step meets (below capacity * capacity, and a few thousand in practice).

A text above the capacity is split into full containers of its own and one remainder, which is
packed like any other size; no other text is split.

Defined cases: null and empty texts have no place and no row; repeated rows are separate items;
ties in size go by id; extra columns don't matter; an empty table gives an empty table. The
containers are numbered from 0 without gaps: first the packed ones, then the full ones of split
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.llm.bpe import VOCABULARY, count_tokens
from twinlens.workspace import Workspace

CAPACITY = 2048
#: Salt buckets in which the texts of one size are ranked.
RANK_BUCKETS = 64


class _Kind:
    """``count`` containers with the same contents [(size, how many)] and the same gap."""

    __slots__ = ("count", "gap", "contents")

    def __init__(self, count: int, gap: int, contents: list[tuple[int, int]]):
        self.count, self.gap, self.contents = count, gap, contents


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of containers as (count, [(size, how many in each), ...]) that hold the histogram."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} outside 1..{capacity}")
        left[size] += n
    third = capacity // 3
    by_gap: dict[int, list[_Kind]] = {}
    done: list[_Kind] = []

    def put(kind: _Kind) -> None:
        if kind.gap:
            by_gap.setdefault(kind.gap, []).append(kind)
        else:
            done.append(kind)

    # large sizes: each with the largest partner that fits, else alone
    for size in range(capacity, third, -1):
        while left[size]:
            top = min(size, capacity - size)
            partners = np.flatnonzero(left[third + 1 : top + 1]) if top > third else ()
            if not len(partners):
                put(_Kind(int(left[size]), capacity - size, [(size, 1)]))
                left[size] = 0
                break
            other = int(partners[-1]) + third + 1
            if other == size:
                k = int(left[size]) // 2
                if k:
                    put(_Kind(k, capacity - 2 * size, [(size, 2)]))
                    left[size] -= 2 * k
                    continue
                # a single one of its size: look for a smaller partner
                smaller = np.flatnonzero(left[third + 1 : size])
                if not len(smaller):
                    put(_Kind(1, capacity - size, [(size, 1)]))
                    left[size] = 0
                    break
                other = int(smaller[-1]) + third + 1
            k = int(min(left[size], left[other]))
            put(_Kind(k, capacity - size - other, [(size, 1), (other, 1)]))
            left[size] -= k
            left[other] -= k
    # small sizes: best fit into the gaps, then new containers
    for size in range(third, 0, -1):
        n = int(left[size])
        for gap in sorted(g for g in by_gap if g >= size):
            if not n:
                break
            each = gap // size
            kinds = by_gap.pop(gap)
            while kinds and n:
                kind = kinds.pop()
                full = min(kind.count, n // each)
                if full:
                    put(_Kind(full, gap - each * size, [*kind.contents, (size, each)]))
                    n -= full * each
                rest = kind.count - full
                if rest and n:  # fewer than ``each`` are left: the last container takes them
                    put(_Kind(1, gap - n * size, [*kind.contents, (size, n)]))
                    n, rest = 0, rest - 1
                if rest:
                    kinds.append(_Kind(rest, gap, kind.contents))
            if kinds:
                by_gap.setdefault(gap, []).extend(kinds)
        if n:
            each = capacity // size
            full, rest = divmod(n, each)
            if full:
                put(_Kind(full, capacity - each * size, [(size, each)]))
            if rest:
                put(_Kind(1, capacity - rest * size, [(size, rest)]))
    done += [k for kinds in by_gap.values() for k in kinds]
    return [(k.count, k.contents) for k in done]


def _places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks within each size."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for count, contents in kinds:
        slot = offset = 0
        for size, each in contents:
            at = used.get(size, 0)
            rows.append((size, at, base, each, slot, offset))
            used[size] = at + count * each
            slot += each
            offset += size * each
        base += count
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    return dict(zip(("size", "at", "container", "each", "slot", "offset"), cols)) | {"containers": base}


OUT = "container bigint, place int, start int, n_tokens int"


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id_col, piece, container, place, start, n_tokens), a row for each piece of each text.

    ``place`` counts the pieces of a container from 0, ``start`` is where the piece begins in it;
    ``piece`` counts the pieces of one text, the full ones first.
    """
    spark = sizes.sparkSession
    ws = Workspace(spark, "packing")
    items = ws.save(
        sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n"))
        .where("n > 0")
        .withColumn("size", F.expr(f"cast(n % {capacity} as int)"))
        .withColumn("pieces", F.expr(f"n div {capacity}"))
        .withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(RANK_BUCKETS)).cast("int")),
        "items",
    )
    # a row a size and bucket: at most capacity * RANK_BUCKETS, whatever the corpus
    counts = items.groupBy("size", "bucket").agg(F.count("*").alias("n"), F.sum("pieces").alias("pieces")).toPandas()
    counts = counts.sort_values(["size", "bucket"]).reset_index(drop=True)
    counts["first"] = counts.groupby("size")["n"].cumsum() - counts["n"]
    histogram = counts[counts["size"] > 0].groupby("size")["n"].sum()
    plan = _places(plan_containers({int(s): int(n) for s, n in histogram.items()}, capacity))
    by_bucket = counts.groupby("bucket")["pieces"].sum().reindex(range(RANK_BUCKETS), fill_value=0).astype("int64")
    full_base = {b: int(x) for b, x in (by_bucket.cumsum() - by_bucket).items()}
    ranks = spark.createDataFrame(
        pd.DataFrame({"size": counts["size"].astype("int32"), "bucket": counts["bucket"].astype("int32"), "first": counts["first"].astype("int64")}),
        "size int, bucket int, first bigint",
    )
    ranked = (
        items.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id")))
        .join(F.broadcast(ranks), ["size", "bucket"])
        .select("id", "size", "pieces", (F.col("first") + F.col("r") - 1).alias("rank"))
    )
    shared = spark.sparkContext.broadcast(plan)
    kind = sizes.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        first = np.searchsorted(p["size"], np.arange(capacity + 2))
        key = p["size"] * (1 << 44) + p["at"]
        for b in batches:
            size = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(3).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1
            assert (i >= first[size]).all()
            q, r = np.divmod(rank - p["at"][i], p["each"][i])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2).cast(pa.int32()),
                    pa.array(p["container"][i] + q),
                    pa.array((p["slot"][i] + r).astype(np.int32)),
                    pa.array((p["offset"][i] + r * size).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                ],
                names=[id_col, "piece", "container", "place", "start", "n_tokens"],
            )

    packed = ranked.where("size > 0").mapInArrow(place, f"`{id_col}` {kind}, piece int, {OUT}")
    bases = spark.createDataFrame([(b, x) for b, x in full_base.items()], "bucket int, base bigint")
    split = (
        items.where("pieces > 0")
        .withColumn("before", F.sum("pieces").over(Window.partitionBy("bucket").orderBy("id", "n", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)))
        .join(F.broadcast(bases), "bucket")
        .withColumn("piece", F.explode(F.expr("sequence(0, cast(pieces as int) - 1)")))
        .select(
            F.col("id").alias(id_col),
            "piece",
            (F.lit(plan["containers"]) + F.col("base") + F.coalesce("before", F.lit(0)) + F.col("piece")).alias("container"),
            F.lit(0).alias("place"),
            F.lit(0).alias("start"),
            F.lit(capacity).alias("n_tokens"),
        )
    )
    return packed.unionByName(split)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Containers for whole texts, sized by ``count_tokens``."""
    return fill_containers(count_tokens(df, vocabulary, id_col, text_col), capacity, id_col)


def container_fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, the least containers possible and the share filled."""
    return placed.agg(
        F.count_distinct("container").alias("containers"),
        F.count("*").alias("pieces"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    ).select(
        "containers",
        "pieces",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"),
    )


#: Share of the containers' space that a plan for many texts must fill.
LEAST_FILL = 0.98


def audit_containers(sizes: DataFrame, placed: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """One row of what is wrong with a plan: containers above the capacity, with a gap or an overlap, or without a number;
    texts that aren't placed whole exactly once, and texts split without need. ``filled`` says whether the space used
    reaches LEAST_FILL, or all containers but one are the least possible. Ids must be unique."""
    w = Window.partitionBy("container").orderBy("place")
    rows = placed.select(
        "container",
        (F.col("place") != F.row_number().over(w) - 1).alias("jump"),
        (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("n_tokens")).over(w), F.lit(0))).alias("gap"),
        F.col("n_tokens").alias("n"),
    )
    per = rows.groupBy("container").agg(F.sum("n").alias("n"), F.max(F.col("jump") | F.col("gap")).alias("gaps"))
    boxes = per.agg(
        F.count_if(F.col("n") > capacity).alias("over_capacity"),
        F.count_if("gaps").alias("gaps"),
        (F.max("container") + 1 - F.count("*")).alias("unnumbered"),
        ((F.sum("n") >= LEAST_FILL * capacity * F.count("*")) | (F.count("*") <= F.ceil(F.sum("n") / capacity) + 1)).alias("filled"),
    )
    pieces = placed.groupBy(id_col).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("numbers"))
    n = F.col(size_col)
    texts = (
        sizes.where(n > 0)
        .join(pieces.hint("merge"), id_col, "full_outer")
        .agg(
            F.count_if(F.col("got") == n).alias("documents"),
            F.count_if(F.coalesce(F.col("got") != n, F.lit(True)) | (F.col("numbers") != F.col("pieces"))).alias("not_whole"),
            F.count_if(F.col("pieces") != F.ceil(n / capacity)).alias("needless_splits"),
        )
    )
    return texts.crossJoin(F.broadcast(boxes))  # one row each
