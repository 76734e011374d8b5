"""Trial history of a parameter search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import per_column
from ..functions.moments import correlation
from ..functions.ordering import IN_ONE_TASK, split_ranges
from ..functions.sizing import broadcast_if_small


def running_best(
    trials: DataFrame,
    trial: str = "trial",
    score: str = "score",
    maximize: bool = True,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Add ``best_so_far``. A long history is cut into trial ranges, each starting
    from the best of the ranges before it."""
    pick = F.max if maximize else F.min
    rows = trials.count()
    cut = split_ranges(trials, [trial], in_one_task) if rows > in_one_task else trials.withColumn("__range", F.lit(""))
    # One row per range.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("__range")
        .agg(pick(score).alias("__best"))
        .select("__range", pick("__best").over(earlier).alias("__start"))
    )
    inner = Window.partitionBy("__range").orderBy(trial).rowsBetween(Window.unboundedPreceding, 0)
    within = pick(score).over(inner)
    top = F.greatest(within, "__start") if maximize else F.least(within, "__start")
    return (
        cut.join(broadcast_if_small(starts), "__range")
        .withColumn("best_so_far", top)
        .select(*trials.columns, "best_so_far")
    )


def best_trial(trials: DataFrame, trial: str = "trial", score: str = "score") -> DataFrame:
    """One row ``(best_trial, best_score, trials)``; ties to the first trial."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(trial).alias("t")))
    return trials.agg(best.alias("b"), F.count(F.lit(1)).alias("trials")).select(
        F.col("b.t").alias("best_trial"), (-F.col("b.s")).alias("best_score"), "trials"
    )


def parameter_importance(trials: DataFrame, params: Sequence[str], score: str = "score") -> DataFrame:
    """``(param, importance)``: absolute correlation with the score, as shares of their sum."""

    def make(p: str):
        return {"r": F.abs(correlation(p, score))}

    # One row per parameter.
    every = Window.partitionBy(F.lit(1))
    share = F.try_divide(F.col("r"), F.sum("r").over(every))
    return per_column(trials, params, make).select(F.col("column").alias("param"), share.alias("importance"))
