"""Vector functions on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, never below 0 (nor -0.0); 1 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.greatest(1 - dot(a, b) / lengths, F.lit(0.0))).otherwise(F.lit(1.0))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-7) -> Column:
    """Same length and every pair within the larger of both tolerances."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.greatest(relative * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)))
    return (F.size(a) == F.size(b)) & F.coalesce(F.forall(near, lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def finite(a: Column) -> Column:
    """No null, NaN or infinite element."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
