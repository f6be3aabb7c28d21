"""Sizes, boxes and coverage as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect_similarity(a: Column, b: Column) -> Column:
    """Lesser over greater; 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0.0))).otherwise(0.0)


def aspect_gap(a: Column, b: Column) -> Column:
    return 1.0 - aspect_similarity(a, b)


def fit_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Size within ``longest``, never enlarged, sides at least 1, rounded half to even; raises for sizes that aren't positive."""
    top = F.greatest(width, height)
    good = F.when((width > 0) & (height > 0), True).otherwise(F.raise_error(F.lit("size must be positive")).cast("boolean"))

    def side(x: Column) -> Column:
        scaled = F.greatest(F.lit(1), F.bround(x * float(longest) / top, 0).cast("int"))
        return F.when(good & (top <= longest), x.cast("int")).otherwise(scaled)

    return side(width), side(height)


def polygon_area(points: Column) -> Column:
    """Area of a polygon, an array of structs x, y, by the shoelace formula."""
    n = F.size(points)

    def term(p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % n)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(F.aggregate(F.transform(points, term), F.lit(0.0), lambda s, x: s + x)) / 2.0


def _overlap(lo: Column, hi: Column, size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi, size) - F.greatest(lo, F.lit(0.0)))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / F.nullif(b, F.lit(0.0))))).otherwise(0.0)


def coverage_of_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The original found at a box in the candidate: shares of the original and of the candidate covered."""
    inside = _overlap(x0, x1, width) * _overlap(y0, y1, height)
    return _share(inside, (x1 - x0) * (y1 - y0)), _share(inside, width * height)


def coverage_of_crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The candidate found at a box in the original."""
    return _share(_overlap(x0, x1, width) * _overlap(y0, y1, height), width * height), F.lit(1.0)


def merge_coverage(fo: Column, fc: Column, to: Column, tc: Column, tolerance: float = 0.15) -> tuple[Column, Column, Column]:
    """(original, candidate, source) of feature and template coverage; null means none. Far apart, the
    one that claims less of the original counts."""
    both = fo.isNotNull() & to.isNotNull()
    apart = both & (F.abs(fo - to) > tolerance)
    feature = (apart & (fo <= to)) | (~apart & fo.isNotNull())
    feature = F.coalesce(feature, F.lit(False))
    source = F.when(apart, "conservative-agreement").when(fo.isNotNull(), "homography").when(to.isNotNull(), "template").otherwise("none")
    return F.coalesce(F.when(feature, fo).otherwise(to), F.lit(0.0)), F.coalesce(F.when(feature, fc).otherwise(tc), F.lit(0.0)), source
