"""Exact quantiles that hold at any size.

``percentile`` keeps every distinct value of a group in one task, so it serves
only groups whose row count has been checked.

A whole column beyond that is narrowed: count the values per equal-width bin
inside the bracket that holds a rank, keep the bin with that rank, and repeat
until the bracket is one value. Each round is a column-pruned scan with a
partial aggregation; only bin counts are shuffled.

Large groups are ranked: equal values are counted first, then numbered range by
range, so that no task holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordering
from .columns import numeric_long, per_column, per_numeric_column, quoted
from .lookup import attach, prepare
from .ordering import running_total

IN_ONE_TASK = 2_000_000
BINS = 4096
_INFINITE = math.inf
IN_ONE_GROUP = 100_000


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], in_one_task: int = IN_ONE_TASK
) -> DataFrame:
    """``(column, q array<double>)`` with linear interpolation, NULLs skipped.

    Infinite values and NaN take their places at the ends (NaN last); a quantile that
    falls on one of them is that value, one between a finite and an infinite one is the
    infinite one, and one between a number and NaN is NaN. The values of all columns
    together are gathered in a task only up to ``in_one_task`` of them; beyond that the
    brackets around the ranks are narrowed, with the same result.
    """
    if df.count() * len(columns) <= in_one_task:
        return per_column(df, columns, lambda c: {"q": percentile(df, c, probs)})
    return narrowed(df, columns, probs)


def percentile(df: DataFrame, c: str, probs: Sequence[float]) -> Column:
    """An aggregate for tables of checked size.

    Measures seldom repeat a value, so sorting them beats counting them.
    """
    x = F.col(f"`{c}`").cast("double")
    if not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.percentile(x, [float(p) for p in probs])
    ordered = F.sort_array(F.collect_list(x))
    last = F.count(x) - 1

    def at(p: float) -> Column:
        place = last * F.lit(float(p))
        low = F.get(ordered, F.floor(place).cast("int"))
        high = F.get(ordered, F.ceil(place).cast("int"))
        part = place - F.floor(place)
        # Equal ends need no arithmetic, which infinite values would turn to NaN.
        return F.when((low == high) | (part == 0), low).otherwise(low + part * (high - low))

    return F.when(last >= 0, F.array(*[at(p) for p in probs]))


def group_quantiles(
    df: DataFrame,
    by: str,
    columns: Sequence[str],
    probs: Sequence[float],
    in_one_group: int = IN_ONE_GROUP,
    in_one_task: int = ordering.IN_ONE_TASK,
) -> DataFrame:
    """``(by, column, q array<double>)`` per non-null group."""
    known = df.where(F.col(by).isNotNull())
    sizes = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= in_one_group:
        return _grouped(known, by, columns, probs)
    large = sizes.where(F.col("n") > in_one_group).select(by, F.lit(True).alias("__large"))
    marked = attach(known, prepare(large), [by], {"__large": False})
    small_rows = marked.where(~F.col("__large")).drop("__large")
    large_rows = marked.where("__large").drop("__large")
    return _grouped(small_rows, by, columns, probs).unionByName(
        _ranked(large_rows, by, columns, probs, in_one_task)
    )


def quantile_values(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], in_one_task: int = IN_ONE_TASK
) -> dict[str, list[float] | None]:
    """Fitted quantiles as literals: one short list per column."""
    if not columns:
        return {}
    rows = quantiles(df, columns, probs, in_one_task).collect()
    found = {r["column"]: r["q"] for r in rows}
    return {c: found.get(c) for c in columns}


def _grouped(df: DataFrame, by: str, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    wide = df.groupBy(by).agg(
        *[
            F.struct(F.lit(c).alias("column"), F.percentile(quoted(c).cast("double"), [float(p) for p in probs]).alias("q")).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(by, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def _ranked(
    df: DataFrame, by: str, columns: Sequence[str], probs: Sequence[float], in_one_task: int
) -> DataFrame:
    series = [by, "column"]
    long = numeric_long(df, columns, [by]).where(F.col("value").isNotNull())
    counted = long.groupBy(*series, "value").agg(F.count(F.lit(1)).alias("n"))
    numbered = running_total(
        counted, series, ["value"], F.col("n"), "before", in_one_task=in_one_task
    )
    totals = counted.groupBy(*series).agg(F.sum("n").alias("total"))
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at"))
            for i, p in enumerate(probs)
        ]
    )
    placed = attach(numbered, prepare(totals), series).withColumn("r", F.explode(ranks))
    upto = F.col("before") + F.col("n")
    low, high = F.floor("r.at"), F.ceil("r.at")
    kept = placed.where((high >= F.col("before")) & (low < upto))
    has_low = (low >= F.col("before")) & (low < upto)
    has_high = (high >= F.col("before")) & (high < upto)
    ends = kept.groupBy(*series, F.col("r.i").alias("i"), F.col("r.at").alias("at")).agg(
        F.max(F.when(has_low, F.col("value"))).alias("left"),
        F.max(F.when(has_high, F.col("value"))).alias("right"),
    )
    value = F.col("left") + (F.col("at") - F.floor("at")) * (F.col("right") - F.col("left"))
    # As many rows per group as there are probabilities.
    inside = F.sort_array(F.collect_list(F.struct("i", value.alias("v"))))
    return ends.groupBy(*series).agg(F.transform(inside, lambda e: e["v"]).alias("q"))


def narrowed(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], bins: int = BINS
) -> DataFrame:
    """Whole-column quantiles by bracket narrowing."""
    spark = df.sparkSession
    long = numeric_long(df, columns).where(F.col("value").isNotNull())

    def end(c: str) -> dict[str, Column]:
        x = quoted(c).cast("double")
        finite = F.when(~F.isnan(x) & (F.abs(x) < _INFINITE), x)
        return {
            "n": F.count(x),
            "least": F.count_if(x == -_INFINITE),
            "finite": F.count(finite),
            "most": F.count_if(x == _INFINITE),
            "lo": F.min(finite),
            "hi": F.max(finite),
        }

    ends = per_numeric_column(df, columns, end).where(F.col("n") > 0).collect()
    exact: dict[tuple[str, int], float] = {}
    pending: dict[tuple[str, int], tuple[float, float, int]] = {}
    for r in ends:
        for p in probs:
            at = p * (r["n"] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                inside = rank - r["least"]
                if inside < 0:
                    exact[(r["column"], rank)] = -math.inf
                elif inside < r["finite"]:
                    pending[(r["column"], rank)] = (r["lo"], r["hi"], r["least"])
                else:
                    exact[(r["column"], rank)] = math.inf if inside < r["finite"] + r["most"] else math.nan

    bracket = ["column", "lo", "hi", "below", "ranks"]
    while True:
        for key in [k for k, (lo, hi, _) in pending.items() if lo == hi]:
            exact[key] = pending.pop(key)[0]
        if not pending:
            break
        shared: dict[tuple, list[int]] = {}
        for (column, rank), span in pending.items():
            shared.setdefault((column, *span), []).append(rank)
        # At most two ranks per column and probability.
        brackets = spark.createDataFrame(
            [(*k, ranks) for k, ranks in shared.items()],
            "column string, lo double, hi double, below bigint, ranks array<bigint>",
        )
        # Halves keep hi - lo finite for the whole double range.
        width = F.col("hi") / 2 - F.col("lo") / 2
        # Brackets too narrow to halve are told apart at their upper end; each round parts
        # at least the two ends, so the loop comes to an end.
        share = F.when(width > 0, F.try_divide(F.col("value") / 2 - F.col("lo") / 2, width)).otherwise(
            (F.col("value") > F.col("lo")).cast("double")
        )
        counted = (
            long.join(F.broadcast(brackets), "column")
            .where(F.col("value").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", F.when(F.col("value") == F.col("hi"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))))
            .groupBy(*bracket, "bin")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("value").alias("bin_lo"),
                F.max("value").alias("bin_hi"),
            )
        )
        # At most ``bins + 1`` rows per bracket reach this window.
        order = Window.partitionBy(*bracket).orderBy("bin")
        upto = F.col("below") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = (
            counted.withColumn("upto", upto)
            .withColumn("rank", F.explode("ranks"))
            .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
            .select("column", "rank", "bin_lo", "bin_hi", (F.col("upto") - F.col("n")).alias("before"))
            .collect()
        )
        for r in found:
            pending[(r["column"], r["rank"])] = (r["bin_lo"], r["bin_hi"], r["before"])

    out = []
    for r in ends:
        q = []
        for p in probs:
            at = p * (r["n"] - 1)
            left = exact[(r["column"], math.floor(at))]
            right = exact[(r["column"], math.ceil(at))]
            part = at - math.floor(at)
            q.append(left if left == right or part == 0 else left + part * (right - left))
        out.append((r["column"], q))
    return spark.createDataFrame(out, "column string, q array<double>")
