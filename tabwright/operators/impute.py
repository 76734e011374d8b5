"""Missing-value handling: fit on train, apply to any table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, per_column, quoted, string_columns
from ..functions.quantiles import quantile_values
from .profile import value_counts

# The imputation rules.
DROP_ABOVE_PCT = 80
FLAG_ABOVE_PCT = 20
MODE_BELOW_VALUES = 10
UNKNOWN = "Unknown"


@dataclass
class Imputation:
    """Fitted imputation: columns to drop, to flag, and the value for each column."""

    drop: list[str] = field(default_factory=list)
    flag: list[str] = field(default_factory=list)
    fill: dict[str, object] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            if f.name in self.drop:
                continue
            if f.name in self.fill:
                value = F.lit(self.fill[f.name])
                out.append(F.coalesce(quoted(f.name), value).alias(f.name))
            else:
                out.append(quoted(f.name))
        flags = [
            quoted(c).isNull().cast("int").alias(f"{c}_was_missing")
            for c in self.flag
            if c in df.columns
        ]
        return df.select(*out, *flags)


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Percentage of missing values of every column that has any."""
    if not columns:
        return {}
    rows = F.count(F.lit(1))
    found = per_column(df, columns, lambda c: {"pct": F.try_divide((rows - F.count(quoted(c))) * 100.0, rows)})
    return {r["column"]: r["pct"] for r in found.collect() if r["pct"]}


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_unique, mode)``: the most frequent value, ties to the smallest."""
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_unique"),
            F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode"),
        )
    )


def fit_imputation(
    train: DataFrame, columns: Sequence[str] | None = None, complete_too: bool = False
) -> Imputation:
    """Medians for numbers, the mode or a marker for strings; sparse columns go.

    Columns without gaps in train get no value, unless ``complete_too`` asks for
    one in case another table has gaps there.
    """
    columns = list(columns or train.columns)
    shares = missing_shares(train, columns)
    if complete_too:
        shares = {c: shares.get(c, 0.0) for c in columns}
    fitted = Imputation(drop=[c for c, p in shares.items() if p > DROP_ABOVE_PCT])
    kept = [c for c in shares if c not in fitted.drop]
    numbers = [c for c in numeric_columns(train) if c in kept]
    texts = [c for c in string_columns(train) if c in kept]
    fitted.flag = [c for c in numbers if shares[c] > FLAG_ABOVE_PCT]
    for c, q in quantile_values(train, numbers, [0.5]).items():
        if q:
            fitted.fill[c] = q[0]
    if texts:
        found = {r["column"]: r for r in modes(train, texts).collect()}
        for c in texts:
            few = c in found and found[c]["n_unique"] < MODE_BELOW_VALUES
            fitted.fill[c] = found[c]["mode"] if few else UNKNOWN
    return fitted


def drop_sparse(train: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Without the columns that are missing in more than 80% of the rows."""
    shares = missing_shares(train, list(columns or train.columns))
    return train.drop(*[c for c, p in shares.items() if p > DROP_ABOVE_PCT])
