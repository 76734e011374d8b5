"""Nested cross-fitting, its store, and the contest on top."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import models, search
from tabwright.operators.crossfit import Blend, CrossFit, PredictionStore, Search, Subspace
from tabwright.operators.gram import fold_moments
from tabwright.operators.models import CLASSIFICATION, REGRESSION, Learner
from tabwright.operators.saved import load_learner
from tabwright.operators.stacking import StackLearner, linear_meta
from tabwright.plans.contest import enter, run_contest


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3)) + 1000
    y = x @ np.array([3.0, -2.0, 0.0]) + 5 + rng.normal(size=150)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(150), y=y)
    table = models.feature_table(spark.createDataFrame(pdf), "id", ["a", "b", "c"], "y")
    table = table.withColumn("fold", (F.col("key") % 3).cast("int"))
    return table, x, y


def ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return lambda v: (v - x.mean(0)) @ w + y.mean()


def test_fold_moments_fit_and_score_like_the_rows(numbers):
    table, x, y = numbers
    fold = np.arange(150) % 3
    moments = fold_moments(table)
    fit = moments.ridge([0, 2], 2.0)
    want = ridge(x[fold != 1], y[fold != 1], 2.0)
    got = fit.predict(table, "p").orderBy("key").toPandas().p.to_numpy()
    np.testing.assert_allclose(got, want(x), rtol=1e-8)
    assert moments.squared_error(1, fit) == pytest.approx(np.mean((y - want(x))[fold == 1] ** 2))
    assert moments.squared_error(7, fit) is None


def test_ridge_search_equals_cross_validation_by_hand(numbers):
    table, x, y = numbers
    fold = np.arange(150) % 3
    found = search.search(table, "ridge", REGRESSION, trials=6, folds=3)
    for r in found.trials.collect():
        errors = [np.mean((y - ridge(x[fold != k], y[fold != k], float(r["params"]["alpha"]))(x))[fold == k] ** 2) for k in range(3)]
        assert r["score"] == pytest.approx(-np.mean(errors))


def test_nothing_of_a_held_fold_reaches_its_predictions(spark, numbers):
    """Labels of the held fold are replaced; every contestant predicts that fold as before."""
    table, *_ = numbers
    members = {"one": Subspace(Learner("ridge"), (0,)), "two": Subspace(Learner("ridge"), (1, 2))}
    some = {
        "lasso": Learner("lasso"),
        "score": Blend(members, "score"),
        "search": Blend(members, "search"),
        "tuned": Search("ridge", ({"alpha": 1.0}, {"alpha": 1e5})),
        "stack": StackLearner(members, {"linear": linear_meta(REGRESSION)}),
    }
    other = table.withColumn("y", F.when(F.col("fold") == 1, -F.col("y") * 7).otherwise(F.col("y")))
    fits = [CrossFit(t, REGRESSION, 3) for t in (table, other)]
    for name, learner in some.items():
        a, b = ({r["key"]: r["value"] for r in f.predictions(learner, (1,)).collect()} for f in fits)
        assert a.keys() == {k for k in range(150) if k % 3 == 1} and a == pytest.approx(b), name
        assert fits[0].predictions(learner, (0,)).first()["value"] != fits[1].predictions(learner, (0,)).first()["value"]


def test_each_fit_runs_once_and_is_found_again(spark, numbers, tmp_path):
    table, *_ = numbers
    forest = Learner("forest", {"numTrees": 3, "maxDepth": 2})
    some = {"forest": forest, "lasso": Learner("lasso"), "vote": Blend({"forest": forest, "lasso": Learner("lasso")}, "score")}
    first = CrossFit(table, REGRESSION, 3, str(tmp_path / "store"))
    # Two learners, each with one fold held out (3 ways) and two (3 ways).
    assert first.prepare(some) == 12 and first.prepare(some) == 0
    a = {r["key"]: r["vote"] for r in first.inputs(some, first.folds, ()).collect()}
    again = CrossFit(table, REGRESSION, 3, str(tmp_path / "store"))
    assert again.prepare(some) == 0 and len(again.store.known) == 15
    assert {r["key"]: r["vote"] for r in again.inputs(some, again.folds, ()).collect()} == a
    changed = CrossFit(table.where("key > 0"), REGRESSION, 3, str(tmp_path / "store"))
    assert (changed.identity(forest)[0], (0,)) not in changed.store.known
    assert PredictionStore(spark, str(tmp_path / "store")).entries().count() == 15


def test_a_contest_promotes_and_saves_its_winner(spark, numbers, tmp_path):
    table, *_ = numbers
    some, kinds = enter(REGRESSION, {"ridge": Learner("ridge"), "lasso": Learner("lasso", {"alpha": 0.5})}, tuned=["ridge"], trials=5)
    assert {"ridge_tuned", "lasso", "blend_vote", "blend_score", "blend_search", "stack"} == set(some)
    with pytest.raises(ValueError, match="two folds"):
        run_contest(table, REGRESSION, some, kinds, folds=3)
    table = table.withColumn("fold", (F.col("key") % 4).cast("int"))
    contest = run_contest(table, REGRESSION, some, kinds, folds=4)
    rows = {r["contestant"]: r for r in contest.table.collect()}
    assert set(rows) == set(some) and [n for n, r in rows.items() if r["promoted"]] == [contest.best]
    assert rows[contest.best]["mean_score"] == max(r["mean_score"] for r in rows.values())
    test = table.drop("y", "fold")
    contest.save(str(tmp_path / "winner"))
    loaded = load_learner(spark, str(tmp_path / "winner"))
    a, b = ({r["key"]: r["prediction"] for r in d.collect()} for d in (contest.predict(test), loaded.predict(test, "prediction")))
    assert a == pytest.approx(b) and len(a) == 150


def test_a_contest_of_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=160) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(160), y=y)
    table = models.with_folds(models.feature_table(spark.createDataFrame(pdf), "id", ["a", "b", "c"], "y"), 3)
    learners = {"logistic": Learner("logistic"), "forest": Learner("forest", {"numTrees": 4, "maxDepth": 3})}
    some, kinds = enter(CLASSIFICATION, learners, blends=("score", "search"))
    contest = run_contest(table, CLASSIFICATION, some, kinds, folds=3)
    scores = {r["contestant"]: r["mean_score"] for r in contest.table.collect()}
    assert set(scores) == {"logistic", "forest", "blend_score", "blend_search", "stack"} and min(scores.values()) > 0.7


def test_what_a_contest_refuses(numbers):
    table, *_ = numbers
    with pytest.raises(ValueError, match="two rows"):
        CrossFit(table.union(table), REGRESSION, 3)
    with pytest.raises(ValueError, match="outside"):
        CrossFit(table, REGRESSION, 2)
    with pytest.raises(ValueError, match="unknown stacks"):
        enter(REGRESSION, stacks=("tower",))
    with pytest.raises(ValueError, match="no fold is left"):
        CrossFit(table, REGRESSION, 3).predictions(Learner("lasso"), (0, 1, 2))
