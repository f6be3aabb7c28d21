"""Vector functions over arrays, computed in double precision (M4-M7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for different lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(n, F.lit(0.0)))))


def histogram_cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def embedding_similarity(a: Column, b: Column, backend_a: Column, backend_b: Column) -> tuple[Column, Column]:
    """(similarity in [0, 1], backend), or (0, 'mismatch(a/b)') for different backends."""
    same = backend_a == backend_b
    return (
        F.when(same, histogram_cosine(a, b)).otherwise(0.0),
        F.when(same, backend_a).otherwise(F.concat(F.lit("mismatch("), backend_a, F.lit("/"), backend_b, F.lit(")"))),
    )


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))
