"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
import math

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def num(value: float) -> Column:
    return F.lit(float(value))


def mean_of(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / num(len(cols))


def finite(col: Column, default: Column | float = 0.0) -> Column:
    default = default if isinstance(default, Column) else num(default)
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == num(math.inf))
    return F.when(bad, default).otherwise(col)


def correlation(a: Column | str, b: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both are known; null where one of them does not vary.

    ``corr`` divides by the deviations, which is an error for a flat column.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    joint, u, v = parts if over is None else [p.over(over) for p in parts]
    return F.try_divide(joint, u * v)


def clip(col: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else num(lo)
    hi = hi if isinstance(hi, Column) else num(hi)
    return F.least(F.greatest(col, lo), hi)


def wrap_angle(col: Column) -> Column:
    """Bring a phase difference into (-pi, pi]."""
    return (
        F.when(col > math.pi, col - 2 * math.pi)
        .when(col < -math.pi, col + 2 * math.pi)
        .otherwise(col)
    )


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def largest(cols: Sequence[Column]) -> Column:
    """Greatest of the non-null columns, 0 when there is none above 0."""
    return F.greatest(num(0), *cols) if cols else num(0)


def rounded(col: Column, places: int = 6) -> Column:
    """Round for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(col, places) + num(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, num(0), lambda s, x: s + x * x)
