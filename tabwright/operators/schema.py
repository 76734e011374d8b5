"""What a column is: target, semantic type, task type."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import datetime_columns, numeric_columns, per_column, quoted, string_columns
from ..functions.moments import skew
from .profile import distinct_counts, value_counts

# Names and thresholds that decide a column's role.
TARGET_NAMES = ("target", "label", "y", "class", "response", "outcome")
DATE_NAMES = ("date", "time")
TEXT_SHARE = 0.5
FEW_VALUES = 10
MAX_INTEGER_CLASSES = 20
MAX_CLUSTERED_VALUES = 30
MIN_CLUSTER_SHARE = 0.05
CLASSIFICATION_METRICS = (
    "accuracy", "auc", "logloss", "log_loss", "mlogloss", "f1", "precision", "recall",
    "map@", "ndcg", "categorization", "multiclass", "binary",
)
REGRESSION_METRICS = (
    "rmse", "mse", "mae", "rmsle", "r2", "mape", "squared", "absolute", "error",
)
CLASSIFICATION_NAMES = (
    "class", "category", "label", "target_class", "is_", "has_", "type", "group",
)
REGRESSION_NAMES = (
    "price", "cost", "amount", "value", "score", "rating", "count", "number", "quantity",
)


def target_column(train: DataFrame, test: DataFrame | None) -> str | None:
    """The single column only train has, else a column with a usual target name."""
    if test is None:
        return None
    only_train = [c for c in train.columns if c not in set(test.columns)]
    if len(only_train) == 1:
        return only_train[0]
    return next((c for c in train.columns if c.lower() in TARGET_NAMES), None)


def schema_difference(train: DataFrame, test: DataFrame) -> tuple[list[str], list[str]]:
    """Columns missing from test, and columns only test has."""
    missing = [c for c in train.columns if c not in set(test.columns)]
    extra = [c for c in test.columns if c not in set(train.columns)]
    return missing, extra


def is_id_name(name: str, substring: bool = False) -> bool:
    """Whether ``id`` is a word of the name; ``substring`` also takes it inside words."""
    if substring:
        return "id" in name.lower()
    words = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    return "id" in words


def semantic_types(df: DataFrame, substring_ids: bool = False) -> DataFrame:
    """``(column, semantic_type)``: id, datetime, numeric, text or categorical."""
    named_id = [c for c in df.columns if is_id_name(c, substring_ids)]
    counted = distinct_counts(df).join(F.broadcast(_rows_per_column(df)), "column")
    kind = (
        F.when(
            F.col("column").isin(named_id) | (F.col("n_unique") == F.col("rows")), F.lit("id")
        )
        .when(F.col("column").isin(datetime_columns(df)), F.lit("datetime"))
        .when(F.col("column").isin(numeric_columns(df)), F.lit("numeric"))
        .when(
            F.col("column").isin(string_columns(df))
            & (F.col("n_unique") / F.col("rows") > TEXT_SHARE),
            F.lit("text"),
        )
        .otherwise(F.lit("categorical"))
    )
    return counted.select("column", kind.alias("semantic_type"))


def _rows_per_column(df: DataFrame) -> DataFrame:
    return per_column(df, df.columns, lambda c: {"rows": F.count(F.lit(1))})


def simple_types(df: DataFrame) -> DataFrame:
    """``(column, simple_type)``: numeric, datetime or categorical.

    A string column named after a date counts as datetime when every value parses.
    """
    dated = [
        c
        for c in string_columns(df)
        if any(w in c.lower() for w in DATE_NAMES)
    ]
    is_time, is_number = datetime_columns(df), numeric_columns(df)

    def make(c: str) -> dict[str, Column]:
        if c in is_time:
            return {"simple_type": F.max(F.lit("datetime"))}
        if c in is_number:
            return {"simple_type": F.max(F.lit("numeric"))}
        if c in dated:
            bad = F.count_if(quoted(c).isNotNull() & F.try_to_timestamp(quoted(c)).isNull())
            kind = F.when((bad == 0) & (F.count(quoted(c)) > 0), F.lit("datetime"))
            return {"simple_type": kind.otherwise(F.lit("categorical"))}
        return {"simple_type": F.max(F.lit("categorical"))}

    return per_column(df, df.columns, make)


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """One row about the target: counts, distinct values, range, integrality, top share."""
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    x = F.col(target).cast("double") if numeric else F.lit(None).cast("double")
    counts = (
        df.select(F.col(target).alias("v"), x.alias("x"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))
    )
    seen = F.col("v").isNotNull()
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(seen).alias("n_unique"),
        F.max(F.when(seen, F.col("n"))).alias("largest"),
        F.min(F.when(seen, F.col("n"))).alias("smallest"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.coalesce(F.bool_and(F.col("x") == F.floor("x")), F.lit(False)).alias("integral"),
    )


def simple_task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: classification for strings, few values or 0/1; else regression."""
    facts = target_facts(df, target)
    if target in string_columns(df):
        return facts.select("n_unique", F.lit("classification").alias("task_type"))
    kind = F.when(F.col("n_unique") < FEW_VALUES, F.lit("classification"))
    return facts.select("n_unique", kind.otherwise(F.lit("regression")).alias("task_type"))


def task_type(
    df: DataFrame, target: str, metric: str | None = None, name: str | None = None
) -> DataFrame:
    """One row ``(n_unique, task_type)`` from metric, name, type and values, in that order."""
    facts = target_facts(df, target)
    return facts.select("n_unique", _task_rule(df, target, metric, name).alias("task_type"))


def _task_rule(df: DataFrame, target: str, metric: str | None, name: str | None) -> Column:
    classes, numbers = F.lit("classification"), F.lit("regression")
    integral, n = F.col("integral"), F.col("n_unique")
    if metric is not None:
        if _mentions(metric, CLASSIFICATION_METRICS):
            return classes
        if _mentions(metric, REGRESSION_METRICS):
            return numbers
    if name is not None:
        if _mentions(name, CLASSIFICATION_NAMES):
            return classes
        if _mentions(name, REGRESSION_NAMES):
            return F.when((n <= FEW_VALUES) & integral, classes).otherwise(numbers)
    if not isinstance(df.schema[target].dataType, T.NumericType):
        return classes
    share = F.col("largest") / F.col("rows")
    unit = (F.col("low") >= 0) & (F.col("high") <= 1) & (n > FEW_VALUES)
    clustered = (n <= MAX_CLUSTERED_VALUES) & (share >= MIN_CLUSTER_SHARE)
    return (
        F.when(n == 2, classes)
        .when(integral, F.when(n <= MAX_INTEGER_CLASSES, classes).otherwise(numbers))
        .when(unit, numbers)
        .when(clustered, classes)
        .otherwise(numbers)
    )


def _mentions(text: str, words: Sequence[str]) -> bool:
    return any(w in text.lower() for w in words)


def class_details(df: DataFrame, target: str) -> DataFrame:
    """One row about a class target."""
    return target_facts(df, target).select(
        "n_unique",
        (F.col("missing") > 0).alias("has_missing"),
        (F.col("n_unique") == 2).alias("is_binary"),
        (F.col("n_unique") > 2).alias("is_multiclass"),
        (F.col("largest") / F.col("smallest")).alias("imbalance_ratio"),
    )


def value_details(df: DataFrame, target: str) -> DataFrame:
    """One row about a numeric target."""
    x = F.col(target).cast("double")
    return df.agg(
        (F.count(F.lit(1)) > F.count(target)).alias("has_missing"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        skew(target).alias("skewness"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return value_counts(df, [target]).select(F.col("value").alias("class"), "n")
