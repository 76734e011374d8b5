"""Scores of prediction columns: all models of a table in one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import per_column, quoted
from ..functions.ordering import IN_ONE_TASK, running_total
from ..functions.scalar import log_likelihood


# The thresholds tried.
THRESHOLDS = tuple(i / 100 for i in range(10, 90))


def _model_rows(df: DataFrame, predictions: Sequence[str], make) -> DataFrame:
    return per_column(df, predictions, make).withColumnRenamed("column", "model")


def regression_scores(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """``(model, mse, mae, r2)``."""

    def make(p: str) -> dict[str, Column]:
        err = F.col(y).cast("double") - F.col(p)
        sse = F.sum(err * err)
        sst = F.var_pop(F.when(F.col(p).isNotNull(), F.col(y).cast("double"))) * F.count(err)
        return {
            "mse": F.avg(err * err),
            "mae": F.avg(F.abs(err)),
            "r2": F.when(sst > 0, 1 - sse / sst),
        }

    return _model_rows(df, predictions, make)


def class_scores(
    df: DataFrame, y: str, predictions: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    """``(model, accuracy, precision, recall, f1, logloss)`` for 0/1 labels."""

    def make(p: str) -> dict[str, Column]:
        yes, truth = F.col(p) > threshold, F.col(y) == 1
        tp = F.count_if(yes & truth)
        fp, fn = F.count_if(yes & ~truth), F.count_if(~yes & truth)
        return {
            "accuracy": F.avg((yes == truth).cast("double")),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "logloss": -F.avg(log_likelihood(y, p)),
        }

    return _model_rows(df, predictions, make)


def threshold_scores(
    df: DataFrame, y: str, predictions: Sequence[str], thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """``(model, threshold, tp, fp, fn, precision, recall, f1, best)`` for 0/1 labels, a row above counts as 1.

    One pass counts the classes between neighbouring thresholds; all that follows is a few cells a
    model. ``best`` marks the largest F1 of a model, ties to the lowest threshold. Missing scores
    play no part; precision, recall and F1 are NULL where nothing counts.
    """
    cuts = sorted(set(map(float, thresholds)))
    if not cuts:
        raise ValueError("no thresholds")
    truth = (quoted(y) == 1).cast("bigint")
    long = df.select(truth.alias("y"), *[quoted(p).cast("double").alias(p) for p in predictions])
    long = long.unpivot(["y"], [quoted(p) for p in predictions], "model", "score").where("score is not null and y is not null")
    levels = F.array(*map(F.lit, cuts))
    passed = F.size(F.filter(levels, lambda t: F.col("score") > t))
    cells = long.groupBy("model", passed.alias("passed")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # A cell counts for every threshold that its scores pass, and once for none of them in the totals.
    every = F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1)))
    above = F.col("at") < F.col("passed")
    sums = cells.withColumn("at", every).groupBy("model", "at").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, F.lit(0)).otherwise(F.col("pos"))).alias("fn"),
    )
    scored = sums.select(
        "model",
        F.get(levels, F.col("at")).alias("threshold"),
        "tp",
        "fp",
        "fn",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )
    # One row per threshold.
    first = Window.partitionBy("model").orderBy(F.desc_nulls_last("f1"), "threshold")
    return scored.withColumn("best", F.row_number().over(first) == 1)


def auc_scores(
    df: DataFrame, y: str, predictions: Sequence[str], in_one_task: int = IN_ONE_TASK
) -> DataFrame:
    """``(model, auc)`` with tied scores counted half; NULL where a class is missing."""
    long = df.select(y, *[F.col(p).cast("double").alias(p) for p in predictions])
    long = long.unpivot([y], list(predictions), "model", "score")
    return ranked_auc(long, y, ["model"], df.count(), in_one_task)


def ranked_auc(
    scored: DataFrame, y: str, series: Sequence[str], rows: int, in_one_task: int = IN_ONE_TASK
) -> DataFrame:
    """AUC per series of a long ``(series..., y, score)`` table; ``rows`` bounds a series.

    Equal scores are summed before anything is ordered, and the running count of
    negatives is taken range by range when a series is large.
    """
    truth = (F.col(y) == 1).cast("bigint")
    levels = (
        scored.where(F.col("score").isNotNull())
        .groupBy(*series, "score")
        .agg(F.sum(truth).alias("pos"), F.sum(1 - truth).alias("neg"))
    )
    below = running_total(levels, series, ["score"], F.col("neg"), "below", rows, in_one_task)
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*series).agg(F.when(pairs > 0, won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def fold_scores(
    df: DataFrame, y: str, predictions: Sequence[str], fold: str = "fold", kind: str = "classification"
) -> DataFrame:
    """``(model, fold, score)``: AUC for classes, negative MSE for numbers."""
    long = df.select(fold, y, *[F.col(p).cast("double").alias(p) for p in predictions])
    long = long.unpivot([fold, y], list(predictions), "model", "score")
    if kind == "classification":
        return ranked_auc(long, y, ["model", fold], df.count()).select(
            "model", fold, F.col("auc").alias("score")
        )
    err = F.col(y).cast("double") - F.col("score")
    return long.groupBy("model", fold).agg((-F.avg(err * err)).alias("score"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """``(model, mean_score, std_score, folds)``, best first."""
    return (
        scores.groupBy("model")
        .agg(
            F.avg("score").alias("mean_score"),
            F.stddev_pop("score").alias("std_score"),
            F.count("score").alias("folds"),
        )
        .orderBy(F.desc("mean_score"), "model")
    )


def best_model(scores: DataFrame) -> DataFrame:
    """One row: the model of highest mean score, ties to the first name."""
    board = scores.groupBy("model").agg(F.avg("score").alias("mean_score"))
    best = F.min(F.struct((-F.col("mean_score")).alias("s"), "model"))
    return board.agg(best.alias("b")).select(
        F.col("b.model").alias("best_model"), (-F.col("b.s")).alias("best_score")
    )


def top_importances(importances: DataFrame, k: int = 20) -> DataFrame:
    """``(feature, importance)`` averaged over models, the ``k`` largest."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(k)
