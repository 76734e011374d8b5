"""Small literal tables: nulls, ties, constants, single rows, NaN."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from tabwright.functions.columns import nan_to_null
from tabwright.functions.quantiles import group_quantiles, narrowed
from tabwright.operators import profile, quality, schema


def test_missing_values_count_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None)], "x double, s string")
    found = rows_by(profile.missing_values(nan_to_null(df)), "column")
    assert found["x"]["missing"] == 2 and found["s"]["missing"] == 2
    assert found["x"]["pct"] == 66.67 and found["x"]["high_missing"]


def test_moments_need_enough_values_and_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, c double")
    assert all(r["skewness"] is None and r["kurtosis"] is None for r in profile.moments(df).collect())
    wide = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 30)], "x double")
    row = profile.moments(wide).first()
    s = pd.Series([1, 2, 4, 9, 30.0])
    assert row["skewness"] == pytest.approx(s.skew()) and row["kurtosis"] == pytest.approx(s.kurt())


def test_describe_equals_pandas_on_nulls(spark):
    values = [None, 3.0, 1.0, 10.0, None, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = profile.describe(df).first()
    want = pd.Series(values).describe()
    for name, place in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("mean", "mean"), ("std", "std")):
        assert row[name] == pytest.approx(want[place])


def test_describe_beyond_one_task_is_exact(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    small = rows_by(profile.describe(lines), "column")
    large = rows_by(profile.describe(lines, in_one_task=10), "column")
    for c, row in small.items():
        row.pop("column")
        for k, v in row.items():
            assert large[c][k] == pytest.approx(v, rel=1e-12), (c, k)


@pytest.mark.parametrize("bins", [50, 4096])
def test_narrowed_quantiles_with_extremes(spark, bins):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 8, 500), [-1e300, 1e300], np.zeros(200)])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = narrowed(df, ["x"], [0, 0.1, 0.25, 0.5, 0.9, 1.0], bins).first()["q"]
    assert got == pytest.approx(list(np.quantile(values, [0, 0.1, 0.25, 0.5, 0.9, 1.0])), rel=1e-12)


def test_group_quantiles_split_large_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["a", "b", "b"] + [None] * 50, "x": rng.normal(size=953).round(1)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["q"] for r in group_quantiles(df, "g", ["x"], [0.5, 0.9], 50, 60).collect()}
    want = pdf.groupby("g")["x"].quantile([0.5, 0.9]).unstack()
    assert set(got) == {"hot", "a", "b"}
    for g, q in got.items():
        assert q == pytest.approx(list(want.loc[g]))


def test_correlation_with_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 1.0, 7.0), (3.0, 5.0, 7.0)], "a double, b double, c double")
    found = {(r["feature1"], r["feature2"]): r["corr"] for r in profile.correlations(df).collect()}
    assert found[("a", "c")] is None and found[("b", "c")] is None
    assert found[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])


def test_correlations_with_gaps_and_many_columns(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(60, 14)) + 1e6, columns=[f"c{i}" for i in range(14)])
    pdf["c13"] = pdf["c0"] * 2 + rng.normal(size=60)
    holed = pdf.assign(h=pdf["c0"].where(rng.random(60) > 0.3), k=pdf["c1"].where(rng.random(60) > 0.3))
    for table in (pdf, holed):
        want = table.corr()
        df = nan_to_null(spark.createDataFrame(table))
        got = profile.correlations(df).collect()
        assert len(got) == len(table.columns) * (len(table.columns) - 1) // 2
        for r in got:
            assert r["corr"] == pytest.approx(want.loc[r["feature1"], r["feature2"]], abs=1e-9)


def test_correlation_of_a_pair_constant_where_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, None)], "a double, b double")
    assert profile.correlations(df).first()["corr"] is None


def test_histogram_of_one_value_and_last_bin(spark):
    one = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    assert [tuple(r) for r in profile.histogram(one).collect()] == [("x", 15, 2)]
    ends = spark.createDataFrame([(0.0,), (30.0,)], "x double")
    assert {r["bin"] for r in profile.histogram(ends).collect()} == {0, 29}


def test_distinct_counts_keep_large_integers_and_texts_apart(spark):
    big = 2**53
    rows = [(big, "x" * 100), (big + 1, "x" * 101), (big + 2, None)]
    df = spark.createDataFrame(rows, "n bigint, t string")
    found = rows_by(profile.distinct_counts(df), "column")
    assert found["n"]["n_unique"] == 3 and found["t"]["n_unique"] == 2


def test_all_null_column_profile(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    report = rows_by(quality.quality_report(df), "column")
    assert report["x"]["all_null"] and report["s"]["all_null"] and not report["x"]["constant"]
    assert profile.describe(df).first()["count"] == 0
    assert profile.distributions(df).first()["outliers_pct"] == 0
    assert profile.distinct_counts(df).where("n_unique > 0").count() == 0


def test_duplicate_rows_few_and_many(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "z")], "k int, s string")
    assert tuple(quality.duplicate_rows(few).first()) == (6, 3)
    clean = spark.range(50)
    assert tuple(quality.duplicate_rows(clean).first()) == (50, 0)


def test_top_values_ties_by_value_and_group_limit(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacc"], "s string")
    top = profile.top_values(df, k=2).orderBy("rank")
    assert [r["value"] for r in top.collect()] == ["a", "b"]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_target_column_rules(spark):
    train = spark.createDataFrame([(1, 2, 3)], "a int, b int, Label int")
    assert schema.target_column(train, train.drop("b")) == "b"
    assert schema.target_column(train, train) == "Label"
    assert schema.target_column(train, None) is None


def test_id_names():
    assert schema.is_id_name("user_id") and schema.is_id_name("PassengerId") and not schema.is_id_name("width")
    assert schema.is_id_name("width", substring=True)


def test_checks_raise(spark):
    empty = spark.createDataFrame([], "x int")
    with pytest.raises(ValueError, match="data is empty"):
        quality.check_frame(empty)
    with pytest.raises(ValueError, match="is None"):
        quality.check_frame(None)
    with pytest.raises(ValueError, match="no values"):
        quality.check_target(spark.createDataFrame([(None,)], "y int"), "y")
    with pytest.raises(ValueError, match="1 keys without"):
        quality.check_same_keys(spark.range(3), spark.range(2), "id")


def test_task_types_by_values(spark):
    def kind(values, ddl="y double", **hints):
        df = spark.createDataFrame([(v,) for v in values], ddl)
        return schema.task_type(df, "y", **hints).first()["task_type"]

    assert kind([0.0, 1.0, 1.0]) == "classification"
    assert kind([float(i) for i in range(30)]) == "regression"
    assert kind([float(i) for i in range(15)]) == "classification"
    assert kind([i / 100 for i in range(50)]) == "regression"
    assert kind([0.5, 1.5, 2.5] * 4) == "classification"
    assert kind(["a", "b", "c"], "y string") == "classification"
    assert kind([0.0, 1.0], metric="RMSE") == "regression"
    assert kind([1.0, 2.0, 5.0], name="rating") == "classification"


def test_profile_reads_each_table_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = profile.correlations(lines, ["l_quantity", "l_tax", "l_discount"])._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("FileScan parquet") == 1
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in physical
    assert "Python" not in plan


def test_insights_fire(spark):
    df = spark.createDataFrame([(float(i**4), float(i**4) * 2, None) for i in range(20)], "a double, b double, c string")
    rules = {r["rule"]: r["value"] for r in profile.insights(df).collect()}
    assert rules == {"missing": 1, "high_correlation": 1, "skewed": 2}


def test_approximate_distinct(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    found = rows_by(profile.distinct_counts(df, approximate=True), "column")
    assert found["k"]["n_unique"] == 10 and math.isclose(found["id"]["n_unique"], 1000, rel_tol=0.15)


def test_wide_tables_give_the_same_statistics(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.lognormal(size=(50, 20)), columns=[f"c{i}" for i in range(20)])
    pdf["c3"] = pdf["c3"].where(rng.random(50) > 0.2)
    df = nan_to_null(spark.createDataFrame(pdf))
    got = rows_by(profile.moments(df), "column")
    assert got["c3"]["skewness"] == pytest.approx(pdf["c3"].skew())
    assert got["c19"]["kurtosis"] == pytest.approx(pdf["c19"].kurt())
    assert [r["column"] for r in profile.top_variance(df, k=4).collect()] == list(pdf.var().nlargest(4).index)
    wide = rows_by(profile.describe(df, in_one_task=5), "column")
    assert wide["c3"]["q75"] == pytest.approx(pdf["c3"].quantile(0.75)) and wide["c3"]["std"] == pytest.approx(pdf["c3"].std())
