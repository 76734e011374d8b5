"""Column profiling. Each operator is a fixed number of passes, whatever the column count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    quoted,
    numeric_columns,
    per_column,
    per_numeric_column,
    string_columns,
    typed_long,
)
from ..functions.comoments import pair_moments
from ..functions.moments import correlation, excess_kurtosis, skew
from ..functions.quantiles import IN_ONE_TASK, percentile, quantile_values, quantiles

QUARTILES = (0.25, 0.5, 0.75)

# The profile's thresholds.
HIGH_MISSING_PCT = 50
HIGH_CORRELATION = 0.8
HIGH_CARDINALITY = 50
IMBALANCE_RATIO = 0.2
IQR_FENCE = 1.5
MANY_COLUMNS = 100
SKEWED = 1


def basic_info(df: DataFrame, name: str = "train") -> DataFrame:
    """``(table, metric, value)``: rows, columns and columns per type."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        label = f"type {f.dataType.simpleString()}"
        kinds[label] = kinds.get(label, 0) + 1
    known = {"columns": len(df.columns), **kinds}
    facts = [F.struct(F.lit("rows").alias("metric"), F.col("n").alias("value"))] + [
        F.struct(F.lit(k).alias("metric"), F.lit(v).cast("bigint").alias("value"))
        for k, v in known.items()
    ]
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(name).alias("table"), F.inline(F.array(*facts)))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: count, percentage and the high-missing flag."""
    rows = F.count(F.lit(1))
    counted = per_column(
        df,
        columns or df.columns,
        lambda c: {"missing": rows - F.count(quoted(c)), "pct": F.try_divide((rows - F.count(quoted(c))) * 100.0, rows)},
    )
    return counted.where(F.col("missing") > 0).select(
        "column",
        "missing",
        F.round("pct", 2).alias("pct"),
        (F.round("pct", 2) > HIGH_MISSING_PCT).alias("high_missing"),
    )


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, in_one_task: int = IN_ONE_TASK
) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = columns or numeric_columns(df)
    order = ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    named = [F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    if df.count() <= in_one_task:
        fused = per_column(
            df,
            columns,
            lambda c: {**_summary(c), "q": percentile(df, c, QUARTILES)},
        )
        return fused.select("*", *named).select(*order)
    fences = quantiles(df, columns, QUARTILES, in_one_task).select("column", *named)
    # Both sides have one row per column.
    return per_numeric_column(df, columns, _summary).join(F.broadcast(fences), "column", "left").select(*order)


def _summary(c: str) -> dict[str, Column]:
    x = quoted(c).cast("double")
    return {
        "count": F.count(quoted(c)),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
    }


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample-adjusted skewness and excess kurtosis per numeric column."""
    columns = columns or numeric_columns(df)
    return per_numeric_column(df, columns, lambda c: {"skewness": skew(c), "kurtosis": excess_kurtosis(c)})


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row for a two-class target: min/max class ratio and the severe flag."""
    sizes = target_distribution(df, target)
    ratio = F.min("n") / F.max("n")
    return (
        sizes.agg(F.count(F.lit(1)).alias("classes"), ratio.alias("ratio"))
        .where(F.col("classes") == 2)
        .select("classes", "ratio", (F.col("ratio") < IMBALANCE_RATIO).alias("severe"))
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature1, feature2, corr)`` for every pair i < j, over the rows that hold both values.

    NULL where one of them does not vary there. Any number of columns takes the same way
    (``functions.comoments``): means and centred products of each pair, merged stably.
    """
    columns = list(columns or numeric_columns(df))
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    spread = F.sqrt("sii") * F.sqrt("sjj")
    flat = (F.col("sii") <= 0) | (F.col("sjj") <= 0)
    # Rounding may leave the range; NaN would count as the largest.
    r = F.try_divide("sij", spread)
    held = F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pair_moments(df, columns).select(
        F.get(names, F.col("i")).alias("feature1"),
        F.get(names, F.col("j")).alias("feature2"),
        F.when(~flat, held).alias("corr"),
    )


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    found = correlations(df, columns).where(F.abs("corr") > HIGH_CORRELATION)
    return found.withColumn("corr", F.round("corr", 3))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` strongest of the high correlations."""
    found = high_correlations(df, columns)
    return found.orderBy(F.desc(F.abs("corr")), "feature1", "feature2").limit(k)


def target_correlations(
    df: DataFrame, target: str, columns: Sequence[str] | None = None, k: int = 5
) -> DataFrame:
    """The ``k`` highest and ``k`` lowest correlations with the target."""
    features = [c for c in (columns or numeric_columns(df)) if c != target]
    against = per_column(df, features, lambda c: {"corr": correlation(c, target)})
    against = against.where(F.col("corr").isNotNull())
    # One row per column: an unpartitioned window is harmless here.
    high = F.row_number().over(Window.orderBy(F.desc("corr"), "column"))
    low = F.row_number().over(Window.orderBy("corr", F.desc("column")))
    ranked = against.select("column", "corr", high.alias("from_top"), low.alias("from_bottom"))
    return ranked.where((F.col("from_top") <= k) | (F.col("from_bottom") <= k))


def distributions(
    df: DataFrame, columns: Sequence[str] | None = None, in_one_task: int = IN_ONE_TASK
) -> DataFrame:
    """mean, std, min, max, quartiles and the share of outliers per numeric column."""
    columns = list(columns or numeric_columns(df))
    fences = quantile_values(df, columns, QUARTILES, in_one_task)

    def make(c: str) -> dict[str, Column]:
        x = quoted(c).cast("double")
        q25, q50, q75 = fences[c] or (None, None, None)
        out = F.lit(0)
        if q25 is not None:
            reach = IQR_FENCE * (q75 - q25)
            out = F.count_if((x < q25 - reach) | (x > q75 + reach))
        stats = _summary(c)
        return {
            **{k: stats[k] for k in ("mean", "std", "min", "max")},
            "q25": F.lit(q25).cast("double"),
            "q50": F.lit(q50).cast("double"),
            "q75": F.lit(q75).cast("double"),
            "outliers_pct": F.try_divide(out * 100.0, F.count(F.lit(1))),
        }

    return per_column(df, columns, make)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` over the non-null values of all given columns."""
    long = df.select(*[quoted(c).cast("string").alias(c) for c in columns])
    long = long.unpivot([], [quoted(c) for c in columns], "column", "value")
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column; ties by value.

    The rank filter becomes a group limit before the shuffle, so only ``k`` rows
    per column and task move.
    """
    counted = value_counts(df, columns or string_columns(df))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """``(column, n_unique)``, NULLs not counted.

    The exact count is a two-step aggregation over all columns of a type together
    instead of one expansion per distinct aggregate.
    """
    columns = list(columns or df.columns)
    if approximate:
        return per_column(df, columns, lambda c: {"n_unique": F.approx_count_distinct(quoted(c))})
    return reduce(DataFrame.unionByName, [_distinct_of(part) for part in typed_long(df, columns)])


def _distinct_of(long: DataFrame) -> DataFrame:
    groups = long.groupBy("column", "value").agg(F.lit(1).alias("one"))
    return groups.groupBy("column").agg(F.count_if(F.col("value").isNotNull()).alias("n_unique"))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, missing count and the high-cardinality flag per string column."""
    columns = list(columns or string_columns(df))
    missing = per_column(
        df, columns, lambda c: {"missing_count": F.count(F.lit(1)) - F.count(quoted(c))}
    )
    unique = distinct_counts(df, columns)
    # One row per column on both sides.
    return missing.join(F.broadcast(unique), "column", "left").select(
        "column",
        F.col("n_unique").alias("unique_values"),
        "missing_count",
        (F.col("n_unique") > HIGH_CARDINALITY).alias("high_cardinality"),
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """``(column, bin, n)``: equal-width bins over the non-null range, the last one closed."""
    columns = list(columns or numeric_columns(df))
    ends = {
        r["column"]: (r["lo"], r["hi"])
        for r in per_column(
            df,
            columns,
            lambda c: {"lo": F.min(quoted(c).cast("double")), "hi": F.max(quoted(c).cast("double"))},
        ).collect()
    }

    def bin_of(c: str) -> Column:
        lo, hi = ends[c]
        if lo is None:
            return F.lit(None).cast("bigint")
        if lo == hi:  # a single value sits in the middle of a unit-wide range
            lo, hi = lo - 0.5, hi + 0.5
        at = F.floor((quoted(c).cast("double") - lo) / (hi - lo) * bins)
        # ``least`` skips NULL, which belongs to no bin.
        return F.when(quoted(c).isNotNull(), F.least(at, F.lit(bins - 1))).cast("bigint")

    binned = df.select(*[bin_of(c).alias(c) for c in columns]).unpivot([], columns, "column", "bin")
    return (
        binned.where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def variances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, position, variance)`` with the sample variance."""
    columns = list(columns or numeric_columns(df))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return per_numeric_column(
        df, columns, lambda c: {"variance": F.var_samp(quoted(c).cast("double"))}
    ).withColumn("position", place - 1)


def top_variance(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """The ``k`` columns of largest variance; ties by column position."""
    known = variances(df, columns).where(F.col("variance").isNotNull())
    return known.orderBy(F.desc("variance"), "position").limit(k)


def insights(df: DataFrame) -> DataFrame:
    """``(rule, value, message)`` for the rules that fire."""
    spark_rows = df.agg(F.lit(len(df.columns)).cast("bigint").alias("value")).where(
        F.col("value") > MANY_COLUMNS
    )
    found = {
        "many_columns": (spark_rows, "columns in the table"),
        "missing": (_row_count(missing_values(df)), "of the columns hold gaps"),
    }
    if len(numeric_columns(df)) > 1:
        found["high_correlation"] = (
            _row_count(high_correlations(df)),
            "pairs of columns correlate strongly",
        )
    if numeric_columns(df):
        skewed = moments(df).where(F.abs("skewness") > SKEWED)
        found["skewed"] = (_row_count(skewed), "numeric columns lean to one side")
    parts = [
        rows.where(F.col("value") > 0).select(
            F.lit(rule).alias("rule"),
            "value",
            F.concat_ws(" ", F.col("value").cast("string"), F.lit(text)).alias("message"),
        )
        for rule, (rows, text) in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def top_missing(df: DataFrame, k: int = 10) -> DataFrame:
    return missing_values(df).orderBy(F.desc("missing"), "column").limit(k)


