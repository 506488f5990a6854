"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided normal quantiles of the supported confidence levels.
Z = {0.90: 1.644854, 0.95: 1.959964, 0.99: 2.575829}


def wilson(hits: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; null where n is 0."""
    z = Z[confidence]
    p = hits / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def harmonic(p: Column, r: Column) -> Column:
    """The harmonic mean; 0 where both are 0."""
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def strict_sum(x: Column) -> Column:
    """The sum, or null if any value is missing."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def r6(c: Column, name: str) -> Column:
    """Rounded to six places under a name, as results are compared across engines."""
    return F.round(c, 6).alias(name)
