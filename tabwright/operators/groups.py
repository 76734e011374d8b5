"""Group statistics and lags, with hot groups split over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.lookup import Lookup, attach, prepare
from ..functions.ordering import IN_ONE_TASK, split_ranges
from ..functions.quantiles import IN_ONE_GROUP, group_quantiles
from ..functions.sizing import MAX_ROWS
from ..session import cut_lineage

SIMPLE_STATS = ("mean", "std", "max", "min")
ALL_STATS = (*SIMPLE_STATS, "median")


def _stat(kind: str, c: str) -> Column:
    x = quoted(c).cast("double")
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "max": F.max(x),
        "min": F.min(x),
    }[kind]


def group_table(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    stats: Sequence[str] = ALL_STATS,
    in_one_group: int = IN_ONE_GROUP,
) -> DataFrame:
    """One row per group: ``{c}_{stat}_by_{group}`` for every column in one aggregation."""
    known = df.where(F.col(group).isNotNull())
    simple = [s for s in stats if s != "median"]
    named = [_stat(s, c).alias(f"{c}_{s}_by_{group}") for c in columns for s in simple]
    if "median" not in stats:
        return known.groupBy(group).agg(*named)
    # A median keeps a group's values together: only for groups of checked size.
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= in_one_group:
        middle = [F.median(quoted(c).cast("double")).alias(f"{c}_median_by_{group}") for c in columns]
        return known.groupBy(group).agg(*named, *middle)
    medians = (
        group_quantiles(known, group, columns, [0.5], in_one_group)
        .groupBy(group)
        .agg(
            *[
                F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"{c}_median_by_{group}")
                for c in columns
            ]
        )
    )
    return known.groupBy(group).agg(*named).join(medians, group, "left")


@dataclass
class GroupStatistics:
    tables: dict[str, Lookup]

    def transform(self, df: DataFrame) -> DataFrame:
        for group, lookup in self.tables.items():
            df = attach(df, lookup, [group])
        return df


def fit_group_statistics(
    train: DataFrame,
    groups: Sequence[str],
    columns: Sequence[str],
    stats: Sequence[str] = ALL_STATS,
    max_rows: int = MAX_ROWS,
) -> GroupStatistics:
    return GroupStatistics(
        {g: prepare(group_table(train, g, [c for c in columns if c != g], stats), max_rows) for g in groups}
    )


@dataclass
class LagFeatures:
    """``lag_features`` as a step; lags need the rows before, so it works on batches only."""

    group: str
    columns: list[str]
    order: list[str]
    periods: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError("lags are not defined on a stream")
        return lag_features(df, self.group, self.columns, self.order, self.periods)


def group_transform(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Add each group's mean, std, max and min to its rows.

    Aggregated and joined back rather than windowed: a hot group is combined
    before the shuffle and never gathered in one task.
    """
    return fit_group_statistics(df, [group], columns, SIMPLE_STATS).transform(df)


def lag_features(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    order: Sequence[str],
    periods: Sequence[int] = (1, 2, 3),
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Add ``{c}_lag_{p}_by_{group}`` in the total order ``order``.

    Groups too large for one task are cut into ranges of the order, by its next column where one is tied.
    Only the first rows of a range look back across the cut, and the last rows of
    the ranges before it are all they need.
    """
    made = [f"{c}_lag_{p}_by_{group}" for c in columns for p in periods]

    def lags(w) -> list[Column]:
        named = [(c, p, f"{c}_lag_{p}_by_{group}") for c in columns for p in periods]
        return [
            F.when(F.col(group).isNotNull(), F.lag(c, p).over(w)).alias(n) for c, p, n in named
        ]

    total = df.count()
    large = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > in_one_task)
        .select(F.col(group).alias("__large"))
        .toArrow()
        if total > in_one_task
        else None
    )
    if large is None or large.num_rows == 0:
        w = Window.partitionBy(group).orderBy(*order)
        return df.select("*", *lags(w))

    # Fewer than total / in_one_task groups are large.
    hot = F.broadcast(df.sparkSession.createDataFrame(large))
    is_hot = F.col(group).eqNullSafe(F.col("__large"))
    # NULL groups get no lags, so nothing needs them together.
    hot_rows = split_ranges(df.join(hot, is_hot, "left_semi"), order, in_one_task)
    cold = df.join(hot, is_hot, "left_anti")
    cold = cold.select("*", *lags(Window.partitionBy(group).orderBy(*order)))

    reach = max(periods)
    cut = Window.partitionBy(group, "__range")
    first = F.row_number().over(cut.orderBy(*order))
    last = F.row_number().over(cut.orderBy(*[F.desc(o) for o in order]))
    within = hot_rows.select(
        "*", first.alias("__first"), last.alias("__last"), *lags(cut.orderBy(*order))
    )
    # Read three times from here on.
    within = cut_lineage(within)
    body = within.where(F.col("__first") > reach)
    # At most 2 * reach rows per range reach this window.
    seam = within.where((F.col("__first") <= reach) | (F.col("__last") <= reach)).drop(*made)
    heads = seam.select("*", *lags(Window.partitionBy(group).orderBy(*order))).where(
        F.col("__first") <= reach
    )
    out = [*df.columns, *made]
    return cold.select(*out).unionByName(body.select(*out)).unionByName(heads.select(*out))

