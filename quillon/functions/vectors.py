"""Vector arithmetic on arrays of doubles, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def l1_norm(a: Column | str) -> Column:
    return total(F.transform(_c(a), F.abs))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def absdiff(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))


def mean_of(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (x + y) / 2)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b) + EPS)


def negative_euclidean(a: Column | str, b: Column | str) -> Column:
    return -F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def clip_norm(a: Column | str, limit: float, norm: str = "l2") -> Column:
    """Scales a vector down to the limit where its norm is above."""
    size = l2_norm(a) if norm == "l2" else l1_norm(a)
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(size, F.lit(1e-12)))
    return F.transform(_c(a), lambda x: x * scale)
