"""Arithmetic that stays defined under ANSI mode: undefined quotients and logarithms are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def ln(x: Column | str) -> Column:
    """Natural logarithm, null where x <= 0."""
    x = col(x)
    return F.when(x > 0, F.log(x))


def clamp(x: Column | str, low: float, high: float) -> Column:
    """x limited to [low, high]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def finite(x: Column | str) -> Column:
    """x is neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def safe_corr(a: Column | str, b: Column | str, over=None) -> Column:
    """Pearson correlation, null on constant input; over a window if one is given."""
    a, b = col(a), col(b)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])
