"""Sample-adjusted moments as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import quoted


def _n(c: str) -> Column:
    return F.count(quoted(c)).cast("double")


def skew(c: str) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL below three values or without spread."""
    n, x = _n(c), quoted(c).cast("double")
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when((n >= 3) & (F.var_pop(x) > 0), adjusted)


def excess_kurtosis(c: str) -> Column:
    """Adjusted excess kurtosis; NULL below four values or without spread."""
    n, x = _n(c), quoted(c).cast("double")
    below = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    adjusted = ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / below
    return F.when((n >= 4) & (F.var_pop(x) > 0), adjusted)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows with both values; NULL where one does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    # ``corr`` itself divides by zero on a constant, which is an error in ANSI mode.
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)
