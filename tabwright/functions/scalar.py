"""Column expressions: dates, row-wise statistics, clips and thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import quoted

EPSILON = 1e-15
RATIO_GUARD = 1e-8


def date_parts(c: str) -> dict[str, Column]:
    """Calendar parts; the week is the ISO week and Monday is day 0."""
    t = quoted(c)
    parts = {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.day(t),
        "dayofweek": F.weekday(t),
        "dayofyear": F.dayofyear(t),
        "weekofyear": F.weekofyear(t),
        "quarter": F.quarter(t),
    }
    return {f"{c}_{k}": v for k, v in parts.items()}


def date_cycles(c: str) -> dict[str, Column]:
    """Month and day of month as points on a circle."""
    month = F.month(quoted(c)) * (2 * math.pi / 12)
    day = F.day(quoted(c)) * (2 * math.pi / 31)
    return {
        f"{c}_month_sin": F.sin(month),
        f"{c}_month_cos": F.cos(month),
        f"{c}_day_sin": F.sin(day),
        f"{c}_day_cos": F.cos(day),
    }


def row_statistics(columns: Sequence[str], prefix: str = "numeric") -> dict[str, Column]:
    """Mean, std, max, min and range over the non-null values of one row."""
    xs = [quoted(c).cast("double") for c in columns]
    zero = F.lit(0.0)
    n = reduce(Column.__add__, [x.isNotNull().cast("int") for x in xs])
    mean = reduce(Column.__add__, [F.coalesce(x, zero) for x in xs]) / F.nullif(n, F.lit(0))
    # Deviations from the mean rather than sums of squares: no cancellation.
    spread = reduce(Column.__add__, [F.coalesce((x - mean) * (x - mean), zero) for x in xs])
    top, low = F.greatest(*xs), F.least(*xs)
    return {
        f"{prefix}_mean": mean,
        f"{prefix}_std": F.when(n >= 2, F.sqrt(spread / F.nullif(n - 1, F.lit(0)))),
        f"{prefix}_max": top,
        f"{prefix}_min": low,
        f"{prefix}_range": top - low,
    }


def weighted_sum(columns: Sequence[str], weights: Sequence[float]) -> Column:
    terms = [quoted(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return reduce(Column.__add__, terms)


def row_mean(columns: Sequence[str]) -> Column:
    return reduce(Column.__add__, [quoted(c) for c in columns]) / len(columns)


def clip(c: Column | str, low: float, high: float) -> Column:
    """``c`` held within the bounds; NULL stays NULL."""
    x = quoted(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def log_likelihood(y: str, p: str) -> Column:
    """Log-likelihood of one 0/1 label under a clipped probability."""
    held = clip(p, EPSILON, 1 - EPSILON)
    return F.when(F.col(y) == 1, F.ln(held)).otherwise(F.ln(1 - held))


def above(p: str, threshold: float = 0.5, kind: str = "int") -> Column:
    """Strictly above the threshold, as int or boolean."""
    return (F.col(p) > threshold).cast(kind)
