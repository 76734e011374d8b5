"""Learners over a feature table ``(key, features VECTOR, y, ...)`` built from Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .folds import FOLDS, SEED, fold_by_hash
from .metrics import fold_scores

# The default settings of every algorithm.
LOGISTIC_ITERATIONS = 1000
LOGISTIC_C = 1.0
FOREST = {"numTrees": 100, "maxDepth": 10}
BOOSTED = {"maxIter": 100, "maxDepth": 7}
BOOSTED_STEPS = {"boosted": 0.1, "boosted_fast": 0.3, "boosted_slow": 0.03}
BOOSTED_VARIANTS = (
    {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05},
    {"maxIter": 300, "maxDepth": 7, "stepSize": 0.03},
    {"maxIter": 500, "maxDepth": 9, "stepSize": 0.01},
)
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 1.0

CLASSIFICATION, REGRESSION = "classification", "regression"
DEFAULTS = {
    CLASSIFICATION: ("logistic", "forest", "boosted", "boosted_fast", "boosted_slow"),
    REGRESSION: ("ridge", "lasso", "forest", "boosted", "boosted_fast", "boosted_slow"),
}


def feature_table(
    df: DataFrame, key: str, features: Sequence[str], target: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, features, y, kept...)``; missing feature values count as 0."""
    numbers = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)]
    label = [F.col(target).cast("double").alias("y")] if target else []
    wide = df.select(F.col(key).alias("key"), *label, *keep, *numbers)
    names = [f"__f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def make_estimator(
    algorithm: str, task: str, table: DataFrame, params: Mapping[str, object] | None = None, seed: int = SEED
) -> Estimator:
    """The Spark estimator of an algorithm; penalties are scaled to the table's size."""
    given = dict(params or {})
    columns = {"featuresCol": "features", "labelCol": "y"}
    if algorithm == "logistic":
        rows = table.count()
        c = given.pop("C", LOGISTIC_C)
        return LogisticRegression(
            **columns, **{"maxIter": LOGISTIC_ITERATIONS, "regParam": 1.0 / (c * rows), "standardization": False} | given
        )
    if algorithm == "ridge":
        # Spark scales the label by its standard deviation before penalising.
        size = table.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("s")).first()
        alpha = given.pop("alpha", RIDGE_ALPHA)
        penalty = alpha * (size["s"] or 0.0) / size["n"]
        return LinearRegression(
            **columns, **{"solver": "normal", "elasticNetParam": 0.0, "regParam": penalty, "standardization": False} | given
        )
    if algorithm == "lasso":
        alpha = given.pop("alpha", LASSO_ALPHA)
        return LinearRegression(
            **columns, **{"elasticNetParam": 1.0, "regParam": alpha, "standardization": False} | given
        )
    if algorithm == "forest":
        kind = RandomForestClassifier if task == CLASSIFICATION else RandomForestRegressor
        return kind(**columns, **{"seed": seed} | FOREST | given)
    if algorithm in BOOSTED_STEPS:
        kind = GBTClassifier if task == CLASSIFICATION else GBTRegressor
        return kind(**columns, **{"seed": seed, "stepSize": BOOSTED_STEPS[algorithm]} | BOOSTED | given)
    raise ValueError(f"unknown algorithm {algorithm}")


@dataclass
class Fitted:
    """A trained model that adds one prediction column."""

    model: Model
    task: str

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        """P(class 1) or the predicted value beside the given columns."""
        made = self.model.transform(table)
        if self.task == CLASSIFICATION:
            value = vector_to_array("probability")[1]
        else:
            value = F.col("prediction")
        return made.select(*table.columns, value.alias(name))

    def save(self, path: str) -> None:
        """Write the model to a folder every executor can reach."""
        self.model.write().save(path)

    def importances(self, features: Sequence[str]) -> dict[str, float]:
        found = getattr(self.model, "featureImportances", None)
        if found is None:
            return {}
        return {f: float(v) for f, v in zip(features, found.toArray(), strict=True)}


def load_fitted(kind: type[Model], path: str, task: str) -> Fitted:
    """A saved model of a Spark model class."""
    return Fitted(kind.load(path), task)


@dataclass(frozen=True)
class Learner:
    """An algorithm with its parameters."""

    algorithm: str
    params: Mapping[str, object] = field(default_factory=dict)

    def fit(self, table: DataFrame, task: str) -> Fitted:
        return Fitted(make_estimator(self.algorithm, task, table, self.params).fit(table), task)


@dataclass(frozen=True)
class CustomLearner:
    """Any Spark estimator as a learner; it reads ``features`` and ``y``."""

    estimator: Estimator

    def fit(self, table: DataFrame, task: str) -> Fitted:
        return Fitted(self.estimator.fit(table), task)


def default_learners(task: str) -> dict[str, Learner]:
    return {a: Learner(a) for a in DEFAULTS[task]}


def boosted_variants(
    name: str, variants: Sequence[Mapping[str, object]] = BOOSTED_VARIANTS
) -> dict[str, Learner]:
    """The parameter variants tried for a winning boosted model."""
    return {f"{name}_v{i}": Learner(name, v) for i, v in enumerate(variants, 1)}


def _check_binary(table: DataFrame, task: str) -> None:
    if task == CLASSIFICATION and not table.where(~F.col("y").isin(0.0, 1.0)).isEmpty():
        raise ValueError("classification labels must be 0 and 1")


def _together(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Run independent fits side by side, as Spark's own cross-validator does."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(wrap(j)) for j in jobs]]


def fit_all(table: DataFrame, learners: Mapping[str, Learner], task: str, parallelism: int = 2) -> dict[str, Fitted]:
    """Every learner fitted on the whole table."""
    table = table.persist()
    try:
        _check_binary(table, task)
        names = list(learners)
        fits = _together(table.sparkSession, [lambda n=n: learners[n].fit(table, task) for n in names], parallelism)
        return dict(zip(names, fits, strict=True))
    finally:
        table.unpersist()


def predict_all(table: DataFrame, fitted: Mapping[str, Fitted]) -> DataFrame:
    """One prediction column per model."""
    for name, model in fitted.items():
        table = model.predict(table, name)
    return table


def oof_predictions(
    table: DataFrame, learners: Mapping[str, Learner], task: str, folds: int = FOLDS, parallelism: int = 2
) -> DataFrame:
    """``table`` with one out-of-fold prediction column per learner.

    Needs a ``fold`` column with values ``0 .. folds - 1``; any other value, or none,
    raises an error. Every row is predicted by models that never saw its fold.
    """
    table = table.persist()
    try:
        inside = F.coalesce(F.col("fold").between(0, folds - 1), F.lit(False))
        if outside := table.agg(F.count_if(~inside).alias("n")).first()["n"]:
            raise ValueError(f"{outside} rows have a fold outside 0 to {folds - 1}")
        _check_binary(table, task)
        work = [(k, n) for k in range(folds) for n in learners]
        fits = _together(
            table.sparkSession,
            [lambda k=k, n=n: learners[n].fit(table.where(F.col("fold") != k), task) for k, n in work],
            parallelism,
        )
        # The folds' union reads files: made anew for each fold, all shuffles would be read by a few tasks.
        rows = cut_lineage(table)
    finally:
        table.unpersist()
    by_fold = dict(zip(work, fits, strict=True))
    held = [
        predict_all(rows.where(F.col("fold") == k), {n: by_fold[(k, n)] for n in learners})
        for k in range(folds)
    ]
    return reduce(DataFrame.unionByName, held)


def with_folds(table: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    return fold_by_hash(table, ["key"], folds, seed)


def cross_validate(
    table: DataFrame, learners: Mapping[str, Learner], task: str, folds: int = FOLDS, parallelism: int = 2
) -> DataFrame:
    """``(model, fold, score)``: AUC or negative MSE from one round of out-of-fold fits."""
    held = oof_predictions(table, learners, task, folds, parallelism)
    return fold_scores(held, "y", list(learners), "fold", task)


def importance_table(
    table: DataFrame, fitted: Mapping[str, Fitted], features: Sequence[str]
) -> DataFrame:
    """``(model, feature, importance)`` of the tree models: one row per model and feature."""
    rows = [(m, f, v) for m, fit in fitted.items() for f, v in fit.importances(features).items()]
    return table.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
