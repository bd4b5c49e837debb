"""Vector expressions on float arrays; products are summed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = length(a) * length(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(length(a), F.lit(1e-10)))


def wasserstein(a: Column, b: Column) -> Column:
    """Distance of two value lists of equal length, as distributions on a line."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def inverse_wasserstein(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return 1.0 / (wasserstein(a, b) + F.lit(eps))


def kernel(cos: Column, sigma: float = 0.25, distance: bool = False) -> Column:
    """exp(-cos^2 / sigma^2), which weighs dissimilar graphs more; with ``distance`` it is taken of 1 - cos."""
    x = (1.0 - cos) if distance else cos
    return F.exp(-(x * x) / F.lit(sigma * sigma))


def jensen_shannon(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Divergence of two lists that are smoothed and scaled to sums of 1."""

    def scaled(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") + eps)
        return F.transform(x, lambda v: (v.cast("double") + eps) / total)

    def half(u: Column, v: Column) -> Column:
        return u * F.ln(u / ((u + v) / 2.0))

    a, b = scaled(p), scaled(q)
    left = F.aggregate(F.zip_with(a, b, half), F.lit(0.0), lambda s, v: s + v)
    right = F.aggregate(F.zip_with(b, a, half), F.lit(0.0), lambda s, v: s + v)
    return (left + right) / 2.0
