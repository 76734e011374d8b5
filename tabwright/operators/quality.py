"""Data-quality report and input checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import per_column, quoted, string_columns
from ..functions.sizing import settle
from .profile import distinct_counts
from .schema import schema_difference

# The report's thresholds.
WARN_MISSING_PCT = 90
HIGH_CARDINALITY_SHARE = 0.8


def quality_report(df: DataFrame) -> DataFrame:
    """One row per column: missing values, all-null, constant and high-cardinality flags."""
    rows = F.count(F.lit(1))

    def make(c: str) -> dict[str, Column]:
        present = F.count(quoted(c))
        return {
            "missing": rows - present,
            "missing_pct": F.try_divide((rows - present) * 100.0, rows),
            "warn_missing": F.coalesce(
                F.try_divide((rows - present) * 100.0, rows) > WARN_MISSING_PCT, F.lit(False)
            ),
            "all_null": present == 0,
            # One value only: no distinct count needed.
            "constant": F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(False)),
            "rows": rows,
        }

    report = per_column(df, df.columns, make)
    texts = string_columns(df)
    if texts:
        unique = distinct_counts(df, texts)
        # One row per column on both sides.
        report = report.join(F.broadcast(unique), "column", "left")
    else:
        report = report.withColumn("n_unique", F.lit(None).cast("bigint"))
    high = F.coalesce(F.col("n_unique") > F.col("rows") * HIGH_CARDINALITY_SHARE, F.lit(False))
    return report.select(
        "column", "missing", "missing_pct", "warn_missing", "all_null", "constant",
        high.alias("high_cardinality"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``(rows, duplicate_rows)``: rows that repeat an earlier row.

    Eight bytes per row are shuffled to find repeated hashes. Where those are few,
    only rows with such a hash are compared in full; where they are many, all
    rows are, and copies collapse in the partial aggregation.
    """
    columns = df.columns
    hashed = df.withColumn("__hash", F.xxhash64(*columns))
    sizes = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    repeated, small = settle(sizes.where(F.col("__n") > 1).select("__hash"))
    suspects = hashed.join(F.broadcast(repeated), "__hash", "left_semi") if small else df
    groups = suspects.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    again = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return _side_by_side(df.agg(F.count(F.lit(1)).alias("rows")), again)


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two one-row tables in one row."""
    one = F.lit(1).alias("__one")
    return (
        left.select("*", one).join(F.broadcast(right.select("*", one)), "__one").drop("__one")
    )


def check_frame(df: DataFrame | None, name: str = "data") -> None:
    if df is None:
        raise ValueError(f"{name} is None")
    if not df.columns:
        raise ValueError(f"{name} has no columns")
    if df.isEmpty():
        raise ValueError(f"{name} is empty")


def check_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target {target} is not a column")
    check_frame(df, "target table")
    if df.where(F.col(target).isNotNull()).isEmpty():
        raise ValueError(f"target {target} has no values")


def check_same_keys(features: DataFrame, targets: DataFrame, key: str) -> None:
    """Both tables must hold the same row keys."""
    apart = key_mismatch(features, targets, key).first()
    if apart["only_left"] or apart["only_right"]:
        raise ValueError(
            f"{apart['only_left']} keys without a target, {apart['only_right']} targets without features"
        )


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right, and on both sides."""
    one_side = left.select(key).distinct().select(F.col(key), F.lit(True).alias("__left"))
    other = right.select(key).distinct().select(F.col(key), F.lit(True).alias("__right"))
    met = one_side.join(other, key, "full_outer")
    return met.agg(
        F.count_if(F.col("__right").isNull()).alias("only_left"),
        F.count_if(F.col("__left").isNull()).alias("only_right"),
        F.count_if(F.col("__left") & F.col("__right")).alias("both"),
    )


def check_schema(train: DataFrame, test: DataFrame) -> DataFrame:
    """``(column, issue)`` rows for columns missing from or extra in test."""
    missing, extra = schema_difference(train, test)
    rows = [(c, "missing") for c in missing] + [(c, "extra") for c in extra]
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("issue", T.StringType())])
    return train.sparkSession.createDataFrame(rows, schema)


def quality_warnings(df: DataFrame) -> DataFrame:
    """``(column, warning)`` rows of the quality report."""
    report = quality_report(df)
    flags = ["warn_missing", "all_null", "constant", "high_cardinality"]
    return reduce(
        DataFrame.unionByName,
        [report.where(F.col(f)).select("column", F.lit(f).alias("warning")) for f in flags],
    )
