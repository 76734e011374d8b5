"""Fitted flows by version, and what a flow does on request."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.lookup import prepare
from tabwright.operators.encode import CountEncoding, fit_count_encoding, fit_target_encoding
from tabwright.operators.numeric import fit_clipping, fit_standard_scaling
from tabwright.plans.feature_flow import FeatureFlow, FittedFlow
from tabwright.plans.flow_store import FlowStore
from tabwright.streaming.apply import transform_stream
from tests.test_models import people


def frame(df, columns):
    return df.orderBy("person_id").toPandas()[list(columns)]


@pytest.fixture(scope="module")
def whole(spark):
    """A flow with every kind of step, and what it makes of its own train."""
    train = people(spark)
    flow = FeatureFlow("person_id", "target", advanced=True, target_means=["street"], groups=["town"], with_ratios=True, select=False)
    return train, *flow.fit_transform(train)


def test_a_loaded_flow_is_the_saved_one(spark, whole, tmp_path):
    train, flow, _ = whole
    store = FlowStore(spark, str(tmp_path / "flows"))
    assert store.versions().count() == 0
    with pytest.raises(ValueError, match="no such version"):
        store.load()
    assert store.save(flow) == 1 and store.save(FittedFlow(flow.steps[:2], [])) == 2
    fresh = FlowStore(spark.newSession(), store.root)
    assert {r["version"]: r["steps"] for r in fresh.versions().collect()} == {1: len(flow.steps), 2: 2}
    assert len(fresh.load().steps) == 2
    again = fresh.load(1)
    assert again.features == flow.features and [type(s) for s in again.steps] == [type(s) for s in flow.steps]
    test = train.drop("target").where("person_id % 3 = 0")
    pd.testing.assert_frame_equal(frame(again.transform(test), flow.features), frame(flow.transform(test), flow.features))


def test_a_save_that_broke_off_does_not_count(spark, whole, tmp_path):
    train, flow, _ = whole
    store = FlowStore(spark, str(tmp_path / "flows"))

    class Unknown:
        def transform(self, df):
            return df

    with pytest.raises(TypeError, match="Unknown"):
        store.save(FittedFlow([*flow.steps, Unknown()], flow.features))
    assert store.versions().count() == 0 and store.save(flow) == 1


def test_a_stream_restarts_with_its_saved_flow(spark, tmp_path):
    train = people(spark)
    flow = FeatureFlow("person_id", "target", groups=["town"], select=False).fit(train)
    store = FlowStore(spark, str(tmp_path / "flows"))
    store.save(flow)
    train.where("person_id < 100").write.parquet(str(tmp_path / "in"))
    for part in (None, "person_id >= 100"):
        if part:
            train.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        loaded = FlowStore(spark.newSession(), store.root).load()
        stream = loaded and spark.readStream.schema(train.schema).parquet(str(tmp_path / "in"))
        transform_stream(FlowStore(spark, store.root).load(), stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    made = frame(spark.read.parquet(str(tmp_path / "out")), flow.features)
    pd.testing.assert_frame_equal(made, frame(flow.transform(train), flow.features))


def test_large_lookup_tables_stay_tables(spark, tmp_path):
    train = people(spark)
    counts = fit_count_encoding(train, ["street"], max_rows=0)
    store = FlowStore(spark, str(tmp_path / "flows"))
    store.save(FittedFlow([counts], ["street_count"]))
    loaded = store.load()
    assert isinstance(loaded.steps[0], CountEncoding) and not loaded.steps[0].tables["street"].small
    assert frame(loaded.transform(train), ["street_count"]).equals(frame(counts.transform(train), ["street_count"]))


def test_groups_ratios_and_lags_in_a_flow(spark):
    train = people(spark)
    flow = FeatureFlow("person_id", "target", groups=["town"], with_ratios=True, lag_by=("town", "height"), lag_periods=[1], select=False)
    fitted, out = flow.fit_transform(train)
    got = frame(out, ["income_mean_by_town", "height_div_weight", "income_lag_1_by_town"])
    pdf = train.orderBy("person_id").toPandas()
    lag = pdf.sort_values(["height", "person_id"]).groupby("town").income.shift(1).sort_index()
    plain = FeatureFlow("person_id", "target", groups=["town"], with_ratios=True, lag_by=("town", "height"), lag_periods=[1], select=False, scale=False)
    raw = frame(plain.fit_transform(train)[1], got.columns)
    np.testing.assert_allclose(raw.income_mean_by_town, pdf.groupby("town").income.transform("mean"))
    np.testing.assert_allclose(raw.height_div_weight, pdf.height / (pdf.weight + 1e-8))
    np.testing.assert_allclose(raw.income_lag_1_by_town, lag)
    with pytest.raises(ValueError, match="stream"):
        fitted.steps[2].transform(spark.readStream.format("rate").load())


def test_flow_on_small_numbers(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(60), "a": rng.random(60), "b": rng.random(60), "target": rng.integers(0, 2, 60)})
    flow, out = FeatureFlow("k", "target", select=False).fit_transform(spark.createDataFrame(pdf))
    assert out.count() == 60 and "a_X_b" in flow.features
    assert fit_standard_scaling(out, []).params == {} and fit_clipping(out, ["a"], "zscore").bounds


def test_names_with_dots(spark):
    rows = [(i, f"v{i % 30}", float(i), i % 2, f"2024-01-{1 + i % 28:02d}") for i in range(120)]
    train = spark.createDataFrame(rows, "`the.key` long, `c.d` string, `x.y` double, `t.t` int, `d.date` string")
    flow, out = FeatureFlow("the.key", "t.t", advanced=True, target_means=["c.d"], select=False).fit_transform(train)
    assert {"c.d_count", "c.d_freq", "c.d_target_enc", "d.date_month_sin"} <= set(flow.features) and out.count() == 120
    folded = train.withColumn("fold", (F.col("`the.key`") % 3).cast("int"))
    enc = fit_target_encoding(folded, ["c.d"], "t.t", max_rows=0)
    assert enc.transform(enc.transform_train(folded).drop("c.d_target_enc")).count() == 120
    assert prepare(train.select("`c.d`").distinct()).small
