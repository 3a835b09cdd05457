"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = lambda: F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _ZERO(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, _ZERO(), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Each part divided by the vector's length; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), _ZERO(), lambda s, x: s + x)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set: array<array<double>>, array<int> -> array<double>."""
    weight = F.greatest(F.aggregate(mask, _ZERO(), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.reduce(weighted, F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return F.transform(total, lambda x: x / weight)
