"""Numeric feature columns: transforms, products, ratios, row statistics, clips, scales."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, per_column, per_numeric_column, quoted
from ..functions.moments import skew
from ..functions.quantiles import quantile_values
from ..functions.scalar import RATIO_GUARD, clip, row_statistics
from .profile import top_variance

# Gates that bound how many columns are made.
LOG_SKEW = 1
SQUARE_TOP = 3
PRODUCT_TOP = 5
MAX_PRODUCTS = 10
POLY_TOP = 10
ROW_STATS_MIN = 3
SCALE_MIN_MAX = 10
# Derived columns of one scan: the code of more is too long for the JVM to compile.
FEW = 4


@dataclass(frozen=True)
class Term:
    """What a derived column is made of, in plain values that can be stored."""

    op: str
    of: tuple[str, ...]

    def column(self, name: str) -> Column:
        xs = [_x(c) for c in self.of]
        if self.op == "row":
            return row_statistics(self.of)[name]
        if self.op == "log1p":
            return F.log1p(xs[0])
        if self.op == "sqrt":
            return F.sqrt(xs[0])
        if self.op == "product":
            return reduce(Column.__mul__, xs)
        if self.op == "filled_product":
            return reduce(Column.__mul__, [F.coalesce(x, F.lit(0.0)) for x in xs])
        if self.op == "ratio":
            return F.try_divide(xs[0], xs[1] + F.lit(RATIO_GUARD))
        raise ValueError(f"unknown term {self.op}")


@dataclass
class Derived:
    """Columns added by expression: the fitted part is which columns, not which rows."""

    terms: dict[str, Term]

    @property
    def columns(self) -> dict[str, Column]:
        return {n: t.column(n) for n, t in self.terms.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[e.alias(n) for n, e in self.columns.items()])


def _x(c: str) -> Column:
    return quoted(c).cast("double")


def top_columns(train: DataFrame, columns: Sequence[str], k: int) -> list[str]:
    return [r["column"] for r in top_variance(train, columns, k).collect()]


def fit_numeric_features(train: DataFrame, columns: Sequence[str]) -> Derived:
    """Logs of skewed positive columns; squares and roots of the widest ones."""
    columns = list(columns)
    if len(columns) < 2:
        return Derived({})
    gates = {
        r["column"]: r
        for r in per_numeric_column(
            train,
            columns,
            lambda c: {"low": F.min(_x(c)), "skew": skew(c), "variance": F.var_samp(_x(c))},
        ).collect()
    }
    made: dict[str, Term] = {}
    for c in columns:
        g = gates[c]
        if g["low"] is not None and g["low"] > 0 and (g["skew"] or 0) > LOG_SKEW:
            made[f"{c}_log"] = Term("log1p", (c,))
    if len(columns) > SQUARE_TOP:
        spread = [c for c in columns if gates[c]["variance"] is not None]
        widest = sorted(spread, key=lambda c: -gates[c]["variance"])[:SQUARE_TOP]
        for c in widest:
            made[f"{c}_squared"] = Term("product", (c, c))
            if gates[c]["low"] >= 0:
                made[f"{c}_sqrt"] = Term("sqrt", (c,))
    return Derived(made)


def fit_products(train: DataFrame, columns: Sequence[str]) -> Derived:
    """Pairwise products, of the widest five columns when there are more."""
    columns = list(columns)
    if len(columns) > PRODUCT_TOP:
        columns = top_columns(train, columns, PRODUCT_TOP)
    pairs = list(combinations(columns, 2))[:MAX_PRODUCTS]
    return Derived({f"{a}_X_{b}": Term("product", (a, b)) for a, b in pairs})


def ratios(columns: Sequence[str]) -> Derived:
    """Product and guarded ratio of every pair."""
    made: dict[str, Term] = {}
    for a, b in combinations(columns, 2):
        made[f"{a}_x_{b}"] = Term("product", (a, b))
        made[f"{a}_div_{b}"] = Term("ratio", (a, b))
    return Derived(made)


def row_features(columns: Sequence[str]) -> Derived:
    names = row_statistics(columns) if len(columns) >= ROW_STATS_MIN else {}
    return Derived({n: Term("row", tuple(columns)) for n in names})


def fit_polynomial(train: DataFrame, columns: Sequence[str], degree: int = 2) -> Derived:
    """Mixed terms up to ``degree``, missing values as 0; the widest ten columns."""
    columns = list(columns)
    if len(columns) > POLY_TOP:
        columns = top_columns(train, columns, POLY_TOP)
    made: dict[str, Term] = {}
    for d in range(2, degree + 1):
        for term in combinations_with_replacement(columns, d):
            if len(set(term)) > 1:
                made[f"poly_{_term_name(term)}"] = Term("filled_product", tuple(term))
    return Derived(made)


def _term_name(term: Sequence[str]) -> str:
    powers = [(c, term.count(c)) for c in dict.fromkeys(term)]
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers)


@dataclass
class Clipping:
    bounds: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                clip(_x(c), *self.bounds[c]).alias(c) if c in self.bounds else quoted(c)
                for c in df.columns
            ]
        )


def fit_clipping(
    train: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = 1.5
) -> Clipping:
    """Bounds at ``threshold`` IQRs beyond the quartiles, or standard deviations from the mean."""
    columns = list(columns or numeric_columns(train))
    if method == "iqr":
        found = quantile_values(train, columns, [0.25, 0.75])
        bounds = {
            c: (q[0] - threshold * (q[1] - q[0]), q[1] + threshold * (q[1] - q[0]))
            for c, q in found.items()
            if q
        }
    elif method == "zscore":
        bounds = {
            r["column"]: (r["m"] - threshold * r["s"], r["m"] + threshold * r["s"])
            for r in per_numeric_column(
                train, columns, lambda c: {"m": F.avg(_x(c)), "s": F.stddev_samp(_x(c))}
            ).collect()
            if r["s"] is not None
        }
    else:
        raise ValueError(f"unknown clipping method {method}")
    return Clipping(bounds)


@dataclass
class Scaling:
    """``(x - centre) / width`` per column; a width of 0 counts as 1."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            centre, width = self.params[c]
            return ((_x(c) - F.lit(centre)) / F.lit(width or 1.0)).alias(c)

        return df.select(*[scaled(c) if c in self.params else quoted(c) for c in df.columns])


def _by_few(train: DataFrame, columns: Sequence[str], make: Callable[[str], dict[str, Column]]) -> list[Row]:
    """``per_column`` by a few columns at a time, each a scan of its own.

    Derived columns are worked out for the statistic that reads them only, in compiled code; unpivoted
    together, every one of them would be worked out anew for each column.
    """
    columns = list(columns)
    return [r for at in range(0, len(columns), FEW) for r in per_column(train, columns[at : at + FEW], make).collect()]


def fit_standard_scaling(train: DataFrame, columns: Sequence[str]) -> Scaling:
    """Mean and population standard deviation."""
    if not columns:
        return Scaling({})
    rows = _by_few(train, columns, lambda c: {"m": F.avg(_x(c)), "s": F.stddev_pop(_x(c))})
    return Scaling({r["column"]: (r["m"], r["s"]) for r in rows if r["m"] is not None})


def fit_robust_scaling(train: DataFrame, columns: Sequence[str]) -> Scaling:
    """Median and interquartile range."""
    found = quantile_values(train, columns, [0.25, 0.5, 0.75])
    return Scaling({c: (q[1], q[2] - q[0]) for c, q in found.items() if q})


def scalable_columns(train: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than two values and a maximum above ten."""
    columns = list(numeric_columns(train) if columns is None else columns)
    if not columns:
        return []
    tops = {r["column"]: r for r in _by_few(train, columns, lambda c: {"lo": F.min(_x(c)), "hi": F.max(_x(c))})}
    wide = [c for c in columns if tops[c]["hi"] is not None and tops[c]["hi"] > SCALE_MIN_MAX]
    # More than two values: some value lies strictly between the extremes.
    between = _by_few(train, wide, lambda c: {"inner": F.count_if((_x(c) > tops[c]["lo"]) & (_x(c) < tops[c]["hi"]))})
    return [r["column"] for r in between if r["inner"] > 0]


def fit_scaling(
    train: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "standard",
    exclude: Sequence[str] = (),
) -> Scaling:
    chosen = [c for c in (columns or numeric_columns(train)) if c not in set(exclude)]
    if method == "standard":
        return fit_standard_scaling(train, chosen)
    if method == "robust":
        return fit_robust_scaling(train, chosen)
    return Scaling({})


def preprocess(df: DataFrame, config: Mapping[str, object] | None = None) -> DataFrame:
    """Clip outliers, then scale."""
    config = dict(config or {})
    clipped = fit_clipping(
        df,
        method=config.get("outlier_method", "iqr"),
        threshold=config.get("outlier_threshold", 1.5),
    ).transform(df)
    return fit_scaling(
        clipped,
        method=config.get("scaling_method", "standard"),
        exclude=config.get("exclude_from_scaling", ()),
    ).transform(clipped)
