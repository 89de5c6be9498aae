"""Randomness by keyed hash: the same on every engine, partitioning and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def hash_52(*keys: Column | str, seed: int | str = 0) -> Column:
    """A whole number in [0, 2^52) from the keys and the seed."""
    text = F.concat_ws("|", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(*keys: Column | str, seed: int | str = 0) -> Column:
    """A double in [0, 1)."""
    return hash_52(*keys, seed=seed) / F.lit(TWO_52)


def normal(*keys: Column | str, seed: int | str = 0) -> Column:
    """A standard normal double by Box and Muller, from two uniforms in (0, 1)."""
    u = (hash_52(*keys, seed=f"{seed}a") + 1) / F.lit(TWO_52 + 1)
    v = (hash_52(*keys, seed=f"{seed}b") + 1) / F.lit(TWO_52 + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def laplace(*keys: Column | str, seed: int | str = 0) -> Column:
    """A Laplace double of scale 1 by the inverse distribution function."""
    u = (hash_52(*keys, seed=seed) + 1) / F.lit(TWO_52 + 1) - 0.5
    return -F.signum(u) * F.log(1 - 2 * F.abs(u))
