"""Seeded uniform draws: the same for a key whatever the partitioning, and the same in SQL engines with md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) from the seed and the key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in key)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(u: Column, n: Column | int) -> Column:
    """A whole number in 0..n-1."""
    return F.floor(u * n).cast("long")


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """Inverse of the triangular distribution."""
    cut = (mode - low) / (high - low)
    return F.when(u < cut, low + F.sqrt(u * ((high - low) * (mode - low)))).otherwise(high - F.sqrt((1 - u) * ((high - low) * (high - mode))))
