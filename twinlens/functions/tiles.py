"""Fingerprint bits and statistics of 8 x 8 luma tiles as native array expressions (bit stages of I3-I6, I8,
I15-I17, I19, I21, I30). A tile is an array of 64 numbers, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = 8


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return _sum(v) / F.size(v)


def spread(v: Column) -> Column:
    """Population standard deviation."""
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))


def median(v: Column) -> Column:
    s = F.array_sort(v)
    n = F.size(v)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def _bits(v: Column, test) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(test(x), "1").otherwise("0")), "")


def average_bits(v: Column) -> Column:
    bound = F.transform(F.array(v), lambda t: F.struct(t.alias("t"), mean(t).alias("m")))
    return F.element_at(F.transform(bound, lambda b: _bits(b["t"], lambda x: x >= b["m"])), 1)


def median_bits(v: Column) -> Column:
    bound = F.transform(F.array(v), lambda t: F.struct(t.alias("t"), median(t).alias("m")))
    return F.element_at(F.transform(bound, lambda b: _bits(b["t"], lambda x: x > b["m"])), 1)


def difference_bits(v: Column) -> Column:
    """Right greater than left: 7 bits a row."""
    at = F.array(*(F.lit(r * SIDE + c) for r in range(SIDE) for c in range(SIDE - 1)))
    return F.array_join(F.transform(at, lambda i: F.when(F.get(v, i + 1) > F.get(v, i), "1").otherwise("0")), "")


def cosine_matrix(n: int = SIDE) -> list[list[float]]:
    """Orthonormal DCT-II."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * k * (2 * x + 1) / (2 * n)) for x in range(n)] for k in range(n)]


def dct(v: Column) -> Column:
    """The 64 coefficients of a tile, as two passes over rows and columns."""
    c = cosine_matrix()
    rows = F.array(*(_weighted([(F.get(v, F.lit(y * SIDE + x)), c[k][x]) for x in range(SIDE)]) for y in range(SIDE) for k in range(SIDE)))
    basis = F.array(*(F.array(*(F.lit(w) for w in row)) for row in c for _ in range(SIDE)))
    ys = F.array(*(F.lit(y * SIDE) for y in range(SIDE)))

    def column(i: Column, m: Column) -> Column:
        at = F.zip_with(ys, F.get(basis, i), lambda y, w: F.get(m, y + i % SIDE) * w)
        return _sum(at)

    index = F.array(*(F.lit(i) for i in range(SIDE * SIDE)))
    return F.element_at(F.transform(F.array(rows), lambda m: F.transform(index, lambda i: column(i, m))), 1)


def _weighted(terms: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for x, w in terms:
        out = out + x * w
    return out


def dct_bits(v: Column) -> Column:
    """Greater than the median of the 63 coefficients other than the first, whose bit is emitted too."""
    coefficients = F.transform(dct(v), lambda x: F.round(x, 9))
    bound = F.transform(F.array(coefficients), lambda c: F.struct(c.alias("c"), median(F.slice(c, 2, 63)).alias("m")))
    return F.element_at(F.transform(bound, lambda b: _bits(b["c"], lambda x: x > b["m"])), 1)


#: Source index of each place of the tile, by orientation; clockwise rotations, mirrored left to right first.
ORIENTATIONS: dict[str, list[int]] = {}
for _mirror in (False, True):
    for _turns in range(4):
        _name = {(False, 0): "identity", (True, 0): "mirror-h"}.get((_mirror, _turns), ("mirror-h-" if _mirror else "") + f"rot{90 * _turns}")
        _grid = [[r * SIDE + c for c in range(SIDE)] for r in range(SIDE)]
        if _mirror:
            _grid = [row[::-1] for row in _grid]
        for _ in range(_turns):
            _grid = [list(row) for row in zip(*_grid[::-1])]
        ORIENTATIONS[_name] = [i for row in _grid for i in row]


def oriented(v: Column, name: str) -> Column:
    return F.transform(F.array(*(F.lit(i) for i in ORIENTATIONS[name])), lambda i: F.get(v, i))


def mixed_derivative(v: Column) -> Column:
    """The second derivative across and down at the 36 places inside a tile."""
    at = F.array(*(F.lit(y * SIDE + x) for y in range(SIDE - 2) for x in range(SIDE - 2)))
    low = 2 * SIDE
    return F.transform(at, lambda i: F.get(v, i + low + 2) - F.get(v, i + low) - F.get(v, i + 2) + F.get(v, i))


def color_bins(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, bin, n, share): counts in the 64 bins of the two high bits of each channel, and their share of the histogram's
    length. ``pixels`` holds bytes, three a pixel."""
    size = F.floor(F.size(pixels) / 3).cast("int")
    start = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: i * 3))
    channel = lambda i, k: F.shiftright(F.get(F.col(pixels), i + k), 6)
    bins = F.transform(start, lambda i: channel(i, 0) * 16 + channel(i, 1) * 4 + channel(i, 2))
    n = df.select(key, F.explode(bins).alias("bin")).groupBy(key, "bin").agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return n.select(key, "bin", "n", F.round(F.col("n") / length, 6).alias("share"))
