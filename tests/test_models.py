from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegressionModel, NaiveBayes
from pyspark.sql import functions as F

from tabwright.operators import models, search, stacking
from tabwright.operators.models import CLASSIFICATION, REGRESSION, CustomLearner, Learner
from tabwright.plans.feature_flow import FeatureFlow
from tabwright.plans.hooks import StageHooks
from tabwright.plans.training import train_models
from tabwright.streaming.apply import transform_stream

SMALL = {"forest": Learner("forest", {"numTrees": 5, "maxDepth": 3}), "logistic": Learner("logistic")}


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(200), y=y)
    table = models.feature_table(spark.createDataFrame(pdf), "id", ["a", "b", "c"], "y")
    return models.with_folds(table, 3).persist()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3))
    y = x @ np.array([3.0, -2.0, 0.0]) + 5 + rng.normal(size=150)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(150), y=y)
    table = models.feature_table(spark.createDataFrame(pdf), "id", ["a", "b", "c"], "y")
    return models.with_folds(table, 3).persist(), x, y


def test_oof_covers_every_key_once(classes):
    held = models.oof_predictions(classes, SMALL, CLASSIFICATION, 3).toPandas()
    assert sorted(held.key) == list(range(200))
    assert held[["forest", "logistic"]].notna().all().all()
    assert ((held.forest >= 0) & (held.forest <= 1)).all()


def test_cross_validation_scores(classes):
    scores = models.cross_validate(classes, SMALL, CLASSIFICATION, 3).toPandas()
    assert len(scores) == 6 and (scores.score > 0.75).all()


def test_ridge_equals_normal_equations(numbers):
    table, x, y = numbers
    model = Learner("ridge", {"alpha": 2.0}).fit(table, REGRESSION).model
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-6)


def test_lasso_drops_the_noise(numbers):
    table, *_ = numbers
    w = Learner("lasso", {"alpha": 0.5}).fit(table, REGRESSION).model.coefficients.toArray()
    assert abs(w[2]) < 1e-6 and w[0] > 1


def test_labels_must_be_binary(numbers):
    with pytest.raises(ValueError, match="0 and 1"):
        models.fit_all(numbers[0], SMALL, CLASSIFICATION)


def test_custom_estimator_as_learner(classes):
    positive = classes.select("key", "y", "fold", F.col("features"))
    learner = CustomLearner(NaiveBayes(modelType="gaussian", labelCol="y"))
    out = learner.fit(positive, CLASSIFICATION).predict(positive, "p").toPandas()
    assert len(out) == 200 and out.p.between(0, 1).all()


def test_saved_model_predicts_the_same(classes, tmp_path):
    fitted = Learner("logistic").fit(classes, CLASSIFICATION)
    fitted.save(str(tmp_path / "model"))
    again = models.load_fitted(LogisticRegressionModel, str(tmp_path / "model"), CLASSIFICATION)
    both = again.predict(fitted.predict(classes, "a"), "b").select("a", "b").toPandas()
    assert (both.a == both.b).all()


def test_importances_rank_the_signal(classes):
    fitted = models.fit_all(classes, SMALL, CLASSIFICATION)
    table = models.importance_table(classes, fitted, ["a", "b", "c"]).toPandas()
    assert set(table.model) == {"forest"}
    assert table.sort_values("importance").feature.iloc[-1] == "a"


def test_stacks_predict_every_row(classes):
    train, held = stacking.holdout(classes.drop("fold"))
    assert train.count() + held.count() == 200
    for learner in (
        stacking.stack(SMALL, CLASSIFICATION, 2),
        stacking.two_level_stack(SMALL, {"maxIter": 2, "maxDepth": 2}, folds=2),
        stacking.feature_stack(SMALL, CLASSIFICATION, {"maxIter": 2, "maxDepth": 2}, folds=2),
        stacking.VoteLearner(SMALL, {"forest": 3.0}),
    ):
        out = learner.fit(train, CLASSIFICATION).predict(held, "p")
        assert out.columns == [*held.columns, "p"]
        p = out.toPandas()
        assert len(p) == held.count() and p.p.between(0, 1).all()
        assert p[p.y == 1].p.mean() > p[p.y == 0].p.mean()


def test_search_maximises(classes, numbers):
    space = {"C": search.Span(1e-4, 1e2, log=True)}
    found = search.search(classes, "logistic", CLASSIFICATION, space, trials=3, folds=3)
    scores = found.trials.toPandas()
    best = scores.loc[scores.score.idxmax()]
    assert float(best.params["C"]) == pytest.approx(found.best_params["C"])
    ridge = search.search(numbers[0], "ridge", REGRESSION, trials=3, folds=3).trials.toPandas()
    assert (ridge.score < 0).all()


def test_drawn_trials_repeat_and_stay_inside():
    space = search.SPACES["forest"]
    drawn = search.draw_trials(space, 20)
    assert drawn == search.draw_trials(space, 20)
    assert all(50 <= d["numTrees"] <= 500 and d["bootstrap"] in (True, False) for d in drawn)


def test_training_result(classes):
    test = classes.drop("y", "fold")
    result = train_models(classes, CLASSIFICATION, SMALL, test, 3)
    assert set(result.ensembles) == {"vote", "blend", "weights"}
    assert result.best in {*SMALL, *result.ensembles}
    assert result.predictions.count() == 200
    assert result.board.columns == ["model", "mean_score", "std_score", "folds"]


def people(spark):
    rng = np.random.default_rng(9)
    n = 240
    age = rng.integers(18, 80, n).astype(float)
    pdf = pd.DataFrame({
        "person_id": range(n),
        "age": np.where(rng.random(n) < 0.25, np.nan, age),
        "income": rng.lognormal(8, 1, n),
        "height": rng.normal(170, 10, n),
        "weight": rng.normal(70, 9, n),
        "sex": rng.choice(["f", "m"], n),
        "town": rng.choice(["x", "y", "z"], n),
        "street": rng.choice([f"s{i}" for i in range(15)], n),
        "joined_date": pd.date_range("2020-01-01", periods=n, freq="D").strftime("%Y-%m-%d"),
        "target": (age > 50).astype(int),
    })
    from tabwright.functions.columns import nan_to_null

    return nan_to_null(spark.createDataFrame(pdf))


def test_feature_flow_columns(spark):
    train = people(spark)
    flow, out = FeatureFlow("person_id", "target", select=False).fit_transform(train)
    names = set(out.columns)
    assert {"age_was_missing", "sex", "town_x", "town_nan", "street_count", "income_log", "joined_date_month_sin"} <= names
    assert {"numeric_mean", "age_X_income"} <= names and not {"town", "street", "joined_date"} & names
    assert out.count() == 240
    again = flow.transform(train.drop("target"))
    assert [c for c in again.columns if c != "person_id"] == flow.features
    a = out.orderBy("person_id").toPandas()[flow.features]
    b = again.orderBy("person_id").toPandas()[flow.features]
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_feature_flow_selects_and_advances(spark):
    train = people(spark)
    flow, out = FeatureFlow("person_id", "target", advanced=True, target_means=["street"], max_features=12).fit_transform(train)
    assert len(flow.features) <= 12 and "age" in flow.features
    assert out.columns[:2] == ["person_id", "target"]


def test_flow_on_a_stream(spark, tmp_path):
    train = people(spark)
    train.write.parquet(str(tmp_path / "in"))
    flow = FeatureFlow("person_id", "target", select=False).fit(train)
    stream = spark.readStream.schema(train.schema).parquet(str(tmp_path / "in"))
    transform_stream(flow, stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert made.count() == 240 and set(flow.features) <= set(made.columns)


def test_hooks_order_and_errors(spark):
    hooks = StageHooks()
    hooks.register("s", lambda df: df.withColumn("x", F.col("x") * 10))
    hooks.register("s", lambda df: df.withColumn("x", F.col("x") + 1), priority=9)

    def broken(df):
        raise RuntimeError("no")

    hooks.register("s", broken, priority=5)
    out = hooks.apply("s", spark.createDataFrame([(1,)], "x int"))
    assert out.first()["x"] == 20
    assert hooks.errors == [("s", "broken", "no")]
    assert hooks.apply("other", out) is out
