"""Random parameter search scored by Spark's cross-validator."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import FOLDS, SEED
from .gram import MAX_WIDTH, fold_moments
from .models import CLASSIFICATION, REGRESSION, RIDGE_ALPHA, Fitted, make_estimator

TRIALS = 50
EARLY_STOP_TOLERANCE = 0.01


@dataclass(frozen=True)
class Span:
    """A numeric range; ``log`` draws evenly in the logarithm."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def draw(self, rng: random.Random) -> float | int:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        if self.whole:
            return rng.randint(int(self.low), int(self.high))
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class Share(Span):
    """A share of the columns that each tree may split on, as Spark's text parameter."""

    def draw(self, rng: random.Random) -> str:
        return f"{rng.uniform(self.low, self.high):.6f}"


# Search ranges, under the names of Spark's parameters.
SPACES: dict[str, dict[str, object]] = {
    "logistic": {"C": Span(1e-3, 1e3, log=True)},
    "ridge": {"alpha": Span(1e-3, 1e3, log=True)},
    "lasso": {"alpha": Span(1e-3, 1e3, log=True)},
    "forest": {
        "numTrees": Span(50, 500, whole=True),
        "maxDepth": Span(3, 20, whole=True),
        "minInstancesPerNode": Span(1, 10, whole=True),
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
        "bootstrap": [True, False],
    },
    "boosted": {
        "maxIter": Span(50, 500, whole=True),
        "stepSize": Span(0.01, 0.3, log=True),
        "maxDepth": Span(3, 12, whole=True),
        "minInstancesPerNode": Span(5, 100, whole=True),
        "subsamplingRate": Span(0.5, 1.0),
        "featureSubsetStrategy": Share(0.5, 1.0),
    },
    "boosted_fast": {
        "maxIter": Span(50, 500, whole=True),
        "stepSize": Span(0.01, 0.3, log=True),
        "maxDepth": Span(3, 12, whole=True),
        "minInstancesPerNode": Span(1, 10, whole=True),
        "subsamplingRate": Span(0.5, 1.0),
        "featureSubsetStrategy": Share(0.5, 1.0),
        "minInfoGain": Span(1e-8, 1.0, log=True),
    },
    "boosted_slow": {
        "maxIter": Span(50, 500, whole=True),
        "stepSize": Span(0.01, 0.3, log=True),
        "maxDepth": Span(3, 10, whole=True),
        "maxBins": Span(32, 255, whole=True),
    },
}


def draw_trials(space: Mapping[str, object], trials: int = TRIALS, seed: int = SEED) -> list[dict]:
    """The parameter sets to try; the same seed draws the same ones."""
    rng = random.Random(seed)
    return [
        {n: s.draw(rng) if isinstance(s, Span) else rng.choice(list(s)) for n, s in space.items()}
        for _ in range(trials)
    ]


def trial_table(spark: SparkSession, drawn: Sequence[Mapping[str, object]]) -> DataFrame:
    """``(trial, params)`` with the parameters as a string map."""
    rows = [(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(drawn)]
    return spark.createDataFrame(rows, "trial int, params map<string,string>")


@dataclass
class SearchResult:
    best: Fitted
    best_params: dict[str, object]
    trials: DataFrame


def search(
    table: DataFrame,
    algorithm: str,
    task: str,
    space: Mapping[str, object] | None = None,
    trials: int = TRIALS,
    folds: int = FOLDS,
    parallelism: int = 2,
    seed: int = SEED,
) -> SearchResult:
    """Try drawn parameter sets on the given folds, always maximising the score.

    ``trials`` of the result is ``(trial, params, score)`` with AUC or negative MSE. Penalties
    are scaled to the rows that a fold's fit sees. Ridge penalties are all tried on sums that
    two scans keep per fold (``operators.gram``).
    """
    drawn = draw_trials(space or SPACES[algorithm], trials, seed)
    if task != CLASSIFICATION and algorithm == "ridge" and all(set(p) <= {"alpha"} for p in drawn):
        width = len(table.select("features").first()[0])
        if width <= MAX_WIDTH:
            return _ridge_search(table, drawn, folds)
    base = make_estimator(algorithm, task, table)
    # As many as a fit on all folds but one sees.
    rows = table.count() * (folds - 1) / folds
    spread = table.agg(F.stddev_pop("y").alias("s")).first()["s"] or 0.0
    grid = [
        {base.getParam(n): v for n, v in _spark_params(p, algorithm, rows, spread).items()} for p in drawn
    ]
    classes = task == CLASSIFICATION
    if classes:
        # Exact: the curve is not thinned to bins.
        judge = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction", numBins=0)
    else:
        judge = RegressionEvaluator(labelCol="y", metricName="mse")
    tuned = CrossValidator(
        estimator=base,
        estimatorParamMaps=grid,
        evaluator=judge,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(table)
    scores = [m if classes else -m for m in tuned.avgMetrics]
    best = max(range(len(scores)), key=scores.__getitem__)
    history = [(i, {k: str(v) for k, v in p.items()}, float(s)) for i, (p, s) in enumerate(zip(drawn, scores, strict=True))]
    frame = table.sparkSession.createDataFrame(history, "trial int, params map<string,string>, score double")
    return SearchResult(Fitted(tuned.bestModel, task), drawn[best], frame)


def _ridge_search(table: DataFrame, drawn: Sequence[Mapping[str, object]], folds: int) -> SearchResult:
    moments = fold_moments(table)
    scores = []
    for p in drawn:
        errors = []
        for k in range(folds):
            fit = moments.ridge([j for j in range(folds) if j != k], p.get("alpha", RIDGE_ALPHA))
            errors.append(moments.squared_error(k, fit))
        known = [e for e in errors if e is not None]
        scores.append(-sum(known) / len(known))
    best = max(range(len(scores)), key=scores.__getitem__)
    fitted = Fitted(make_estimator("ridge", REGRESSION, table, drawn[best]).fit(table), REGRESSION)
    history = [(i, {k: str(v) for k, v in p.items()}, float(s)) for i, (p, s) in enumerate(zip(drawn, scores, strict=True))]
    frame = table.sparkSession.createDataFrame(history, "trial int, params map<string,string>, score double")
    return SearchResult(fitted, drawn[best], frame)


def _spark_params(params: Mapping[str, object], algorithm: str, rows: float, spread: float) -> dict:
    made = dict(params)
    if algorithm == "logistic" and "C" in made:
        made["regParam"] = 1.0 / (made.pop("C") * rows)
    if algorithm == "ridge" and "alpha" in made:
        made["regParam"] = made.pop("alpha") * spread / rows
    if algorithm == "lasso" and "alpha" in made:
        made["regParam"] = made.pop("alpha")
    return made


def fit_early_stopping(
    table: DataFrame,
    task: str,
    held_fold: int = 0,
    params: Mapping[str, object] | None = None,
    tolerance: float = EARLY_STOP_TOLERANCE,
) -> Fitted:
    """Boosting that stops when the error on the held-out fold no longer improves."""
    marked = table.withColumn("__held", F.col("fold") == held_fold)
    given = {"validationIndicatorCol": "__held", "validationTol": tolerance, **dict(params or {})}
    return Fitted(make_estimator("boosted", task, marked, given).fit(marked), task)
