"""Stacked and voting learners; they fit and predict like any other learner."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import row_mean, weighted_sum
from ..session import cut_lineage
from .folds import FOLDS, SEED, fold_by_hash
from .models import (
    CLASSIFICATION,
    Fitted,
    Learner,
    fit_all,
    importance_table,
    oof_predictions,
    predict_all,
)

# The meta models' settings.
META_BOOSTED = {"maxIter": 50, "maxDepth": 3}
LEVEL_FOLDS = 3
TOP_FEATURES = 20
HOLDOUT_PARTS = 5


def linear_meta(task: str) -> Learner:
    return Learner("logistic" if task == CLASSIFICATION else "ridge")


def _meta_features(table: DataFrame, names: Sequence[str], passed: Sequence[int] = ()) -> DataFrame:
    """``features`` becomes the prediction columns, and the passed original features."""
    inputs = list(names)
    if passed:
        slicer = VectorSlicer(inputCol="features", outputCol="__passed", indices=list(passed))
        table = slicer.transform(table)
        inputs.append("__passed")
    joined = VectorAssembler(inputCols=inputs, outputCol="__meta").transform(table)
    return joined.drop("features", "__passed").withColumnRenamed("__meta", "features")


def _refold(table: DataFrame, folds: int, seed: int) -> DataFrame:
    return fold_by_hash(table.drop("fold"), ["key"], folds, seed)


@dataclass
class FittedStack:
    base: dict[str, Fitted]
    meta: dict[str, Fitted]
    passed: list[int]

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        kept = table.columns
        inputs = predict_all(table, _hidden(self.base))
        second = _meta_features(inputs.withColumn("__kept", F.col("features")), list(_hidden(self.base)), self.passed)
        made = predict_all(second, _hidden(self.meta, "__meta_"))
        blended = row_mean(list(_hidden(self.meta, "__meta_")))
        back = made.drop("features").withColumnRenamed("__kept", "features")
        return back.select(*kept, blended.alias(name))

    def importances(self, features: Sequence[str]) -> dict[str, float]:
        return {}


def _hidden(fitted: Mapping[str, object], prefix: str = "__base_") -> dict[str, object]:
    return {f"{prefix}{n}": f for n, f in fitted.items()}


@dataclass(frozen=True)
class StackLearner:
    """Base learners under meta learners trained on their out-of-fold predictions.

    With ``top_features`` the most important original features are passed on to
    the meta learners, whose predictions are averaged.
    """

    learners: Mapping[str, object]
    meta: Mapping[str, object]
    folds: int = FOLDS
    top_features: int = 0
    seed: int = SEED
    parallelism: int = 2

    def fit(self, table: DataFrame, task: str) -> FittedStack:
        base = fit_all(table, self.learners, task, self.parallelism)
        passed = self._passed(table, base)
        second = self.second_level(table, task, passed)
        meta = fit_all(second, self.meta, task, self.parallelism)
        return FittedStack(base, meta, passed)

    def second_level(self, table: DataFrame, task: str, passed: Sequence[int] = ()) -> DataFrame:
        """The meta learners' training table, written once before they iterate over it."""
        folded = _refold(table, self.folds, self.seed)
        held = oof_predictions(folded, _hidden(self.learners), task, self.folds, self.parallelism)
        wide = _meta_features(held, list(_hidden(self.learners)), passed)
        return cut_lineage(wide.select("key", "y", "features"))

    def _passed(self, table: DataFrame, base: Mapping[str, Fitted]) -> list[int]:
        if not self.top_features:
            return []
        width = len(table.select("features").first()[0])
        names = [str(i) for i in range(width)]
        every = importance_table(table, base, names)
        ranked = every.groupBy("feature").agg(F.avg("importance").alias("v"))
        top = ranked.orderBy(F.desc("v"), F.col("feature").cast("int")).limit(self.top_features).collect()
        return [int(r["feature"]) for r in top]


def stack(learners: Mapping[str, object], task: str, folds: int = FOLDS, parallelism: int = 2) -> StackLearner:
    """A linear meta model on the out-of-fold predictions."""
    return StackLearner(learners, {"linear": linear_meta(task)}, folds, parallelism=parallelism)


def two_level_stack(
    learners: Mapping[str, object], meta: Mapping[str, object] = META_BOOSTED, folds: int = LEVEL_FOLDS, parallelism: int = 2
) -> StackLearner:
    """The first half of the learners stacked, then stacked again with the second half."""
    names = list(learners)
    half = len(names) // 2
    if half < 1:
        raise ValueError("a two-level stack needs at least two learners")
    boosted = Learner("boosted", dict(meta))
    first = StackLearner({n: learners[n] for n in names[:half]}, {"boosted": boosted}, folds, parallelism=parallelism)
    rest = {n: learners[n] for n in names[half:]}
    top = Learner("boosted_fast", dict(meta))
    return StackLearner({"first_level": first, **rest}, {"boosted": top}, folds, seed=SEED + 1, parallelism=parallelism)


def feature_stack(
    learners: Mapping[str, object],
    task: str,
    boosted: Mapping[str, object] | None = None,
    folds: int = FOLDS,
    parallelism: int = 2,
) -> StackLearner:
    """Two meta models over predictions and the top original features, averaged."""
    meta = {
        "boosted": Learner("boosted", dict(boosted or {"maxIter": 100, "maxDepth": 4})),
        "linear": linear_meta(task),
    }
    return StackLearner(learners, meta, folds, TOP_FEATURES, parallelism=parallelism)


@dataclass
class FittedVote:
    fitted: dict[str, Fitted]
    weights: dict[str, float]

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        made = predict_all(table, _hidden(self.fitted))
        total = sum(self.weights.values())
        shares = [self.weights[n] / total for n in self.fitted]
        return made.select(*table.columns, weighted_sum(list(_hidden(self.fitted)), shares).alias(name))

    def importances(self, features: Sequence[str]) -> dict[str, float]:
        return {}


@dataclass(frozen=True)
class VoteLearner:
    """A weighted average of several learners; equal weights by default."""

    learners: Mapping[str, object]
    weights: Mapping[str, float] = field(default_factory=dict)

    def fit(self, table: DataFrame, task: str) -> FittedVote:
        fitted = fit_all(table, self.learners, task)
        return FittedVote(fitted, {n: self.weights.get(n, 1.0) for n in fitted})


def forest_boosted_vote(trees: int = 100) -> VoteLearner:
    """A forest and half as many boosting rounds, equally weighted."""
    return VoteLearner(
        {
            "forest": Learner("forest", {"numTrees": trees, "maxDepth": 10}),
            "boosted": Learner("boosted", {"maxIter": max(1, trees // 2), "maxDepth": 5}),
        },
        {"forest": 0.5, "boosted": 0.5},
    )


def holdout(table: DataFrame, parts: int = HOLDOUT_PARTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """An 80/20 split by hashed key."""
    marked = fold_by_hash(table, ["key"], parts, seed + 7)
    return marked.where(F.col("fold") != 0).drop("fold"), marked.where(F.col("fold") == 0).drop("fold")
