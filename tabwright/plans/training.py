"""Train, score, ensemble and predict in one pass over a feature table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.blend import (
    MIN_BLEND,
    MIN_TOP,
    best_weights_auc,
    best_weights_mse,
    good_models,
    score_weights,
    top_blend,
    vote,
    weighted,
)
from ..operators.metrics import auc_scores, fold_scores, leaderboard, regression_scores
from ..operators.models import CLASSIFICATION, default_learners, fit_all, oof_predictions, predict_all
from ..session import cut_lineage


@dataclass
class TrainingResult:
    scores: DataFrame
    board: DataFrame
    ensembles: dict[str, float]
    best: str
    predictions: DataFrame | None


def train_models(
    table: DataFrame,
    task: str,
    learners: Mapping[str, object] | None = None,
    test: DataFrame | None = None,
    folds: int = 5,
    parallelism: int = 2,
) -> TrainingResult:
    """Cross-validate, rank, blend on out-of-fold predictions, refit and predict test.

    ``table`` has ``(key, features, y, fold)``. One metric serves single models and
    ensembles, so they can be compared; a model without a score (one class in a fold)
    cannot win. Ensembles: the mean, score-weighted blends of all, of the best five and of
    the models at or above the median score, and the best of 200 random weight vectors.
    """
    learners = dict(learners or default_learners(task))
    names = list(learners)
    held = oof_predictions(table, learners, task, folds, parallelism)
    held = cut_lineage(held.select("key", "y", "fold", *names))
    scores = fold_scores(held, "y", names, "fold", task)
    board = leaderboard(scores)
    means = {r["model"]: r["mean_score"] for r in board.collect()}
    errors = task != CLASSIFICATION
    names = [m for m in names if means.get(m) is not None]
    sizes = {m: (-means[m] if errors else means[m]) for m in names}

    makers: dict[str, Callable[[DataFrame], DataFrame]] = {}
    if len(names) >= MIN_BLEND:
        makers["vote"] = lambda df: vote(df, names)
        makers["blend"] = lambda df: weighted(df, score_weights(sizes, errors))
        search = best_weights_mse if errors else best_weights_auc
        found = dict(zip(names, search(held, "y", names).first()["weights"], strict=True))
        makers["weights"] = lambda df: weighted(df, found)
        ranked = board.select("model", board["mean_score"].alias("score")).where(board["model"].isin(names))
        good = [r["model"] for r in good_models(ranked).collect()]
        if MIN_BLEND <= len(good) < len(names):
            makers["good"] = lambda df: weighted(df, score_weights({m: sizes[m] for m in good}, errors))
    if len(names) >= MIN_TOP:
        makers["top"] = lambda df: top_blend(df, sizes, errors)
    ensembles = {n: _one_score(make(held), task) for n, make in makers.items()}
    every = {**{m: means[m] for m in names}, **ensembles}
    best = max(sorted(every), key=every.__getitem__)

    predictions = None
    if test is not None:
        made = predict_all(test, fit_all(table.drop("fold"), learners, task, parallelism))
        if best in makers:
            made = makers[best](made)
        predictions = made.drop("features")
    return TrainingResult(scores, board, ensembles, best, predictions)


def _one_score(df: DataFrame, task: str) -> float:
    if task == CLASSIFICATION:
        return auc_scores(df, "y", ["ensemble"]).first()["auc"]
    return -regression_scores(df, "y", ["ensemble"]).first()["mse"]
