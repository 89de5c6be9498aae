"""Cleaning, parsing and labelling expressions."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of sex that are read.
MALE, FEMALE = ("m", "male"), ("f", "female")


def null_if_nan(x: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def code_match(codes: Column, wanted: list[str], positive: str, negative: str) -> Column:
    """positive if the comma-separated codes have any wanted one; negative otherwise, and for null."""
    found = F.arrays_overlap(F.transform(F.split(codes, ","), lambda x: F.trim(x)), F.array(*map(F.lit, wanted)))
    return F.when(F.coalesce(found, F.lit(False)), positive).otherwise(negative)


def normalize_sex(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*MALE), "Male").when(low.isin(*FEMALE), "Female")


def valid_age(x: Column, most: float = 120.0) -> Column:
    age = x.try_cast("double")
    return F.when(age.between(0.0, most), age)


def activation(x: Column, kind: str) -> Column:
    """relu, tanh, logistic or identity."""
    if kind not in ("relu", "tanh", "logistic", "identity"):
        raise ValueError(kind)
    return {"relu": F.greatest(x, F.lit(0.0)), "tanh": F.tanh(x), "logistic": 1 / (1 + F.exp(-x)), "identity": x}[kind]


def representation_label(method: Column, dimension: Column) -> Column:
    """A printable name of a representation: the method with its dimension, which may be null."""
    name = F.initcap(F.replace(method, F.lit("_"), F.lit(" ")))
    return F.when(dimension.isNull(), name).otherwise(F.format_string("%s %d-D", name, dimension.cast("int")))


def gaussian_label(sigma: Column, clip: Column) -> Column:
    return F.format_string("Gaussian C=%s sigma=%s", F.format_number(clip, 1), F.format_number(sigma, 4))


def gaussian_sigma(epsilon: float, delta: float, clip: float) -> float:
    """The noise scale 2C sqrt(2 ln(1.25/delta))/epsilon. A nominal parameter: no privacy guarantee is claimed."""
    return 2 * clip * sqrt(2 * log(1.25 / delta)) / epsilon


def laplace_scale(epsilon: float, clip: float) -> float:
    return 2 * clip / epsilon


def parse_pairs(values: list[str]) -> list[tuple[str, str]]:
    """'a:b' settings as pairs; anything else is an error."""
    out = [tuple(v.split(":")) for v in values]
    if bad := [v for v, p in zip(values, out) if len(p) != 2 or not all(p)]:
        raise ValueError(f"not of the form a:b: {bad}")
    return out
