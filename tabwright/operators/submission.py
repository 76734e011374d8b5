"""Prediction output: choose, shape, check and compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import per_column, quoted
from ..functions.quantiles import quantile_values
from ..functions.scalar import above
from .impute import modes
from .quality import key_mismatch

# Preference among prediction columns, and the default threshold.
PREFERENCE = ("ensemble", "best_single")
THRESHOLD = 0.5


def choose_prediction(columns: Sequence[str]) -> str:
    """The ensemble if there is one, else the best single model, else the first."""
    return next((p for p in PREFERENCE if p in columns), columns[0])


def shape_output(
    df: DataFrame,
    key: str,
    prediction: str,
    sample: DataFrame,
    task: str = "classification",
    threshold: float | None = None,
) -> DataFrame:
    """Two columns named and typed like the sample's: id and target."""
    id_name, target = sample.columns[:2]
    kind = sample.schema[target].dataType
    cut = THRESHOLD if threshold is None else threshold
    value = F.col(prediction)
    if task == "classification":
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = above(prediction, cut, "int")
        elif isinstance(kind, T.BooleanType):
            value = above(prediction, cut, "boolean")
        elif isinstance(kind, T.StringType):
            as_words = _only_true_false(sample, target)
            value = above(prediction, THRESHOLD, "boolean" if as_words else "int")
    return df.select(F.col(key).alias(id_name), value.alias(target))


def _only_true_false(sample: DataFrame, target: str) -> bool:
    known = F.coalesce(F.col(target).isin("True", "False"), F.lit(False))
    return sample.where(~known).isEmpty()


def fill_output(df: DataFrame) -> DataFrame:
    """Missing numbers become the median, other missing values the mode."""
    rows = F.count(F.lit(1))
    gaps = per_column(df, df.columns, lambda c: {"n": rows - F.count(quoted(c))}).where(F.col("n") > 0)
    holed = {r["column"] for r in gaps.collect()}
    if not holed:
        return df
    numbers = [
        f.name for f in df.schema.fields if f.name in holed and isinstance(f.dataType, T.NumericType)
    ]
    others = [c for c in df.columns if c in holed and c not in numbers]
    fill: dict[str, object] = {
        c: q[0] for c, q in quantile_values(df, numbers, [0.5]).items() if q
    }
    if others:
        fill |= {r["column"]: r["mode"] for r in modes(df, others).collect()}
    return df.select(
        *[
            F.coalesce(quoted(f.name), F.lit(fill[f.name]).cast(_filled_type(f.dataType))).alias(f.name)
            if f.name in fill
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def _filled_type(kind: T.DataType) -> T.DataType:
    """A median may fall between two integers."""
    return T.DoubleType() if isinstance(kind, T.NumericType) else kind


def validate_output(output: DataFrame, sample: DataFrame) -> DataFrame:
    """``(check, expected, got)`` rows, one per failed check."""
    spark = output.sparkSession
    key = sample.columns[0]
    nulls = reduce(lambda a, b: a | b, [quoted(c).isNull() for c in output.columns])
    facts = output.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nulls).alias("nulls")).first()
    wanted = sample.count()
    issues = []
    if facts["nulls"]:
        issues.append(("missing_values", "0", str(facts["nulls"])))
    if output.columns != sample.columns:
        issues.append(("columns", ",".join(sample.columns), ",".join(output.columns)))
    if facts["rows"] != wanted:
        issues.append(("rows", str(wanted), str(facts["rows"])))
    if key in output.columns:
        apart = key_mismatch(output, sample, key).first()
        if apart["only_left"] or apart["only_right"]:
            issues.append(("ids", "0", str(apart["only_left"] + apart["only_right"])))
    return spark.createDataFrame(issues, "check string, expected string, got string")


def prediction_stats(df: DataFrame, prediction: str) -> DataFrame:
    x = F.col(prediction).cast("double")
    return df.agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def compare_outputs(outputs: Mapping[str, DataFrame], prediction: str) -> DataFrame:
    """``(source, rows, mean, std, min, max, n_unique)`` per prediction table.

    Equal predictions are counted first, so the distinct count needs no expansion.
    """
    x = F.col(prediction).cast("double")
    tagged = [df.select(F.lit(name).alias("source"), x.alias("x")) for name, df in outputs.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    stats = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    unique = (
        rows.where(F.col("x").isNotNull())
        .groupBy("source", "x")
        .agg(F.count(F.lit(1)))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_unique"))
    )
    # One row per table on both sides.
    return stats.join(F.broadcast(unique), "source", "left")
