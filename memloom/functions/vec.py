"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norm products below this count as zero vectors.
TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length < TINY, F.lit(0.0)).otherwise(dot(a, b) / length)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n < TINY, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))
