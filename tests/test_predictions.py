from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from tabwright.operators import blend, experiments, folds, metrics, submission, trials
from tabwright.sources.experiment_store import ExperimentStore
from tabwright.sources import tables


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("in_one_task", [5, 10_000])
def test_auc_with_ties(spark, in_one_task):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 300), "a": rng.integers(0, 9, 300) / 9.0, "b": rng.normal(size=300)})
    got = {r["model"]: r["auc"] for r in metrics.auc_scores(spark.createDataFrame(pdf), "y", ["a", "b"], in_one_task).collect()}
    for m in ("a", "b"):
        assert got[m] == pytest.approx(brute_auc(pdf.y.to_numpy(), pdf[m].to_numpy()))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    assert metrics.auc_scores(df, "y", ["p"]).first()["auc"] is None


@pytest.mark.parametrize("in_one_task", [7, 10_000])
def test_stratified_folds_deal_evenly(spark, in_one_task):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = folds.stratified_folds(df, "y", "id", 5, shuffle_seed=3, in_one_task=in_one_task).toPandas()
    sizes = out.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and len(out) == 500
    again = folds.stratified_folds(df.repartition(3), "y", "id", 5, shuffle_seed=3).toPandas()
    assert out.set_index("id").fold.equals(again.set_index("id").fold.loc[out.id]) or (
        out.sort_values("id").fold.tolist() == again.sort_values("id").fold.tolist()
    )


def test_null_class_gets_folds_too(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "id int, y string")
    for limit in (3, 100):
        out = folds.stratified_folds(df, "y", "id", 2, in_one_task=limit).toPandas()
        assert len(out) == 20 and (out.groupby("fold").size() == 10).all()


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([(1, 0.9, 0.4), (0, 0.2, 0.6), (1, 0.7, 0.1)], "y int, a double, b double")
    for kind in ("classification", "regression"):
        w = {r["model"]: r["weight"] for r in blend.posterior_weights(df, "y", ["a", "b"], kind).collect()}
        assert sum(w.values()) == pytest.approx(1) and w["a"] > w["b"]
    assert sum(blend.score_weights({"a": 4.0, "b": 1.0}, errors=True).values()) == pytest.approx(1)
    assert blend.score_weights({"a": 4.0, "b": 1.0}, errors=True)["b"] == pytest.approx(0.8)


def test_posterior_weights_do_not_underflow(spark):
    df = spark.createDataFrame([(1e6, 0.0, 10.0)], "y double, a double, b double")
    w = {r["model"]: r["weight"] for r in blend.posterior_weights(df, "y", ["a", "b"], "regression").collect()}
    assert w == {"a": 0.0, "b": 1.0}


def test_weight_search_finds_the_best(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=200) * 1000 + 1e6
    pdf = pd.DataFrame({"y": y, "a": y + rng.normal(size=200), "b": y + 500, "c": np.zeros(200)})
    grid = blend.simplex_grid(3, 4)
    found = blend.search_weights_mse(spark.createDataFrame(pdf), "y", ["a", "b", "c"], grid).toPandas()
    for row in found.itertuples():
        want = np.mean((pdf[["a", "b", "c"]].to_numpy() @ np.array(row.weights) - y) ** 2)
        assert row.mse == pytest.approx(want, rel=1e-6)
    assert list(found.sort_values("mse").iloc[0].weights) == [1.0, 0.0, 0.0]
    assert len(grid) == 15 and all(sum(w) == pytest.approx(1) for w in grid)


def test_weight_search_auc_scores_every_candidate(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 120), "a": rng.normal(size=120), "b": rng.normal(size=120)})
    grid = blend.simplex_grid(2, 20)
    found = blend.search_weights_auc(spark.createDataFrame(pdf), "y", ["a", "b"], grid, per_pass=8).toPandas()
    assert len(found) == len(grid)
    for row in found.itertuples():
        mix = pdf.a.to_numpy() * row.weights[0] + pdf.b.to_numpy() * row.weights[1]
        assert row.auc == pytest.approx(brute_auc(pdf.y.to_numpy(), mix))


def test_good_models_and_best(spark):
    scores = spark.createDataFrame([("a", 0.7), ("b", 0.7), ("c", 0.5), ("d", 0.9)], "model string, score double")
    assert {r["model"] for r in blend.good_models(scores).collect()} == {"a", "b", "d"}
    assert tuple(blend.best_ensemble(scores, 0.8).first()) == ("d", 0.9, True)
    with pytest.raises(ValueError):
        blend.blend(scores, {"a": 1.0})


@pytest.mark.parametrize("maximize", [True, False])
def test_running_best_over_cuts(spark, maximize):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"trial": np.arange(100), "score": rng.normal(size=100)})
    df = spark.createDataFrame(pdf).repartition(5)
    out = trials.running_best(df, maximize=maximize, in_one_task=9).toPandas().sort_values("trial")
    want = pdf.score.cummax() if maximize else pdf.score.cummin()
    np.testing.assert_allclose(out.best_so_far.to_numpy(), want.to_numpy())


def test_output_shapes_and_checks(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.9)], "k int, p double")
    sample = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id int, y int")
    shaped = submission.shape_output(df, "k", "p", sample)
    assert [tuple(r) for r in shaped.collect()] == [(1, 0), (2, 0), (3, 1)]
    assert submission.validate_output(shaped, sample).isEmpty()
    words = spark.createDataFrame([(1, "yes")], "id int, y string")
    assert dict(submission.shape_output(df, "k", "p", words).dtypes)["y"] == "int"
    assert submission.choose_prediction(["a", "best_single"]) == "best_single"
    assert submission.choose_prediction(["a", "b"]) == "a"
    holes = spark.createDataFrame([(1, None, "u"), (2, 4, None), (3, 7, "u")], "k int, n int, s string")
    filled = rows_by(submission.fill_output(holes), "k")
    assert filled[1]["n"] == 5.5 and filled[2]["s"] == "u"


def test_metric_merge_last_wins(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}', '{"b":3}'), (None, '{"c":1}'), ('{"a":1}', None)], "old string, new string")
    merged = df.select(experiments.merge_metrics("old", "new").alias("m")).collect()
    assert [r["m"] for r in merged] == ['{"a":"1","b":"3"}', '{"c":"1"}', '{"a":"1"}']


def test_store_keeps_the_latest_row(spark, tmp_path):
    store = ExperimentStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([("e1", "started"), ("e2", "started")], "id string, status string")
    store.append("experiments", first)
    store.append("experiments", first.where("id = 'e1'").withColumn("status", F.lit("completed")))
    assert {r["id"]: r["status"] for r in store.read("experiments").collect()} == {"e1": "completed", "e2": "started"}


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.CSV").write_text("x\n")
    (tmp_path / "c").write_text("abc")
    found = {r["extension"]: (r["files"], r["size_bytes"]) for r in tables.inventory_summary(spark, str(tmp_path)).collect()}
    assert found == {".csv": (2, 6), "": (1, 3)}
    plan = tables.file_inventory(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]


def test_csv_nan_becomes_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x\n1,NaN\n2,3.5\n3,\n")
    out = tables.read_table(spark, str(tmp_path / "t.csv"), "k int, x double")
    assert [r["x"] for r in out.orderBy("k").collect()] == [None, 3.5, None]


def test_csv_shapes_count_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,b\n')
    (tmp_path / "empty.csv").write_text("only\n")
    (tmp_path / "c.txt").write_text("no")
    got = {r["name"]: (r["columns"], r["rows"]) for r in tables.csv_shapes(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (2, 2), "empty.csv": (1, 0)}
