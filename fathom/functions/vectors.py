"""Vector arithmetic in double precision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_normalize(a: Column) -> Column:
    """The vector at unit length; a tiny constant keeps zero vectors finite."""
    n = norm(a) + 1e-12
    return F.transform(a, lambda x: x.cast("double") / n)


def is_valid(a: Column, dim: int) -> Column:
    """Whether an embedding is there and has the right length."""
    return F.coalesce(a.isNotNull() & (F.size(a) == dim), F.lit(False))


def hashed_embedding(tokens: Column, dim: int) -> Column:
    """A repeatable stand-in for an embedding model: token counts by hash bucket, at unit length."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return l2_normalize(counts)


def masked_mean(hidden: Column, mask: Column, dim: int) -> Column:
    """Mean over the token axis of an array of vectors, weighted by a mask."""
    weight = F.greatest(_sum(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    at = lambda i: _sum(F.zip_with(hidden, mask, lambda h, m: F.get(h, i).cast("double") * m))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: at(i) / weight)
