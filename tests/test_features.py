from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows_by
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.functions.columns import align_to
from tabwright.functions.lookup import Lookup, attach, hot_keys, prepare
from tabwright.functions.scalar import row_statistics
from tabwright.operators import encode, groups, impute, numeric, reduce, select


def test_imputation_rules(spark):
    rows = [(1, 1.0, "b", None, None), (2, None, "a", None, "x"), (3, 2.0, None, None, None), (4, 10.0, "a", None, None)]
    rows += [(5, 4.0, "b", None, None)]
    df = spark.createDataFrame(rows, "k int, x double, s string, e double, r string")
    fitted = impute.fit_imputation(df)
    assert fitted.drop == ["e"] and fitted.fill["x"] == 3.0
    assert fitted.fill["s"] == "a"  # a tie goes to the smallest
    out = rows_by(fitted.transform(df), "k")
    assert out[2]["x"] == 3.0 and out[3]["s"] == "a" and "e" not in out[1]
    assert fitted.flag == []


def test_missing_flag_above_a_fifth(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    out = impute.fit_imputation(df).transform(df)
    assert out.columns == ["x", "x_was_missing"] and sorted(r[1] for r in out.collect()) == [0, 0, 1]


def test_label_and_one_hot_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r["c"] for r in encode.fit_label_encoding(train, ["c"]).transform(test).collect()] == [0, -1, -1]
    hot = encode.fit_one_hot(train, ["c"]).transform(test)
    assert hot.columns == ["c_a", "c_b", "c_nan"]
    assert [tuple(r) for r in hot.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1)]
    with pytest.raises(ValueError, match="more than 2 classes"):
        encode.fit_label_encoding(train.union(spark.createDataFrame([("q",)], "c string")), ["c"])


@pytest.mark.parametrize("max_rows", [500, 0])
def test_count_and_frequency_small_and_salted(spark, max_rows):
    values = ["hot"] * 300 + [f"v{i}" for i in range(40)] + [None] * 60
    train = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, c string")
    test = spark.createDataFrame([(0, "hot"), (1, "new"), (2, None)], "k int, c string")
    counts = encode.fit_count_encoding(train, ["c"], max_rows=max_rows)
    freqs = encode.fit_frequency_encoding(train, ["c"], max_rows=max_rows)
    assert counts.tables["c"].small == bool(max_rows)
    assert {k: r["c_count"] for k, r in rows_by(counts.transform(test), "k").items()} == {0: 300, 1: 0, 2: 0}
    on_train = counts.transform(train)
    assert on_train.count() == len(values)
    assert on_train.agg(F.sum("c_count")).first()[0] == 300 * 300 + 40
    got = {k: r["c_freq"] for k, r in rows_by(freqs.transform(test), "k").items()}
    assert got == {0: pytest.approx(300 / 340), 1: 0.0, 2: 0.0}


def test_salted_join_splits_hot_keys(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(df, ["k"], 32).collect()
    assert [(r["k"], r["__salts"]) for r in hot] == [(7, 11)]
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(df, Lookup(table, False), ["k"])
    assert joined.count() == 3000 and joined.where("k = 7").select("n").distinct().collect()[0][0] == 1001
    assert joined.columns == ["id", "k", "n"]


def test_target_encoding_equals_brute_force(spark):
    random.seed(1)
    rows = [(i, random.choice("abc"), i % 3, float(random.randint(0, 9))) for i in range(60)]
    rows += [(60, "once", 0, 5.0), (61, None, 1, 3.0)]
    pdf = pd.DataFrame(rows, columns=["k", "c", "fold", "y"])
    train = spark.createDataFrame(rows, "k int, c string, fold int, y double")
    overall = pdf.y.mean()
    for max_rows in (500, 0):
        fitted = encode.fit_target_encoding(train, ["c"], "y", max_rows=max_rows)
        got = rows_by(fitted.transform_train(train), "k")
        for r in pdf.itertuples():
            rest = pdf[(pdf.c == r.c) & (pdf.fold != r.fold)].y
            want = overall if r.c is None or rest.empty else rest.mean()
            assert got[r.k]["c_target_enc"] == pytest.approx(want)
        test = spark.createDataFrame([(0, "a"), (1, "new"), (2, None)], "k int, c string")
        out = rows_by(fitted.transform(test), "k")
        assert out[0]["c_target_enc"] == pytest.approx(pdf[pdf.c == "a"].y.mean())
        assert out[1]["c_target_enc"] == out[2]["c_target_enc"] == pytest.approx(overall)


def test_group_statistics_with_null_group_and_single_row(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, None, 9.0)], "k int, g string, x double")
    out = rows_by(groups.fit_group_statistics(df, ["g"], ["x"]).transform(df), "k")
    assert out[1]["x_mean_by_g"] == 2.0 and out[1]["x_std_by_g"] == pytest.approx(math.sqrt(2))
    assert out[1]["x_median_by_g"] == 2.0 and out[3]["x_std_by_g"] is None and out[4]["x_mean_by_g"] is None


def test_group_medians_of_hot_groups(spark):
    pdf = pd.DataFrame({"g": [1] * 400 + list(range(2, 50)), "x": np.arange(448) % 37 * 1.5})
    table = groups.group_table(spark.createDataFrame(pdf), "g", ["x"], in_one_group=20)
    want = pdf.groupby("g").x.median()
    got = {r["g"]: r["x_median_by_g"] for r in table.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_lag_over_cuts_equals_pandas(spark, data):
    n = data.draw(st.integers(30, 80))
    seed = data.draw(st.integers(0, 999))
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "k": np.arange(n),
        "g": rng.choice(["hot", "hot", "hot", "cold"], n),
        "t": rng.integers(0, data.draw(st.integers(1, 40)), n),
        "v": rng.normal(size=n),
    })
    df = spark.createDataFrame(pdf).repartition(4)
    got = groups.lag_features(df, "g", ["v"], ["t", "k"], [1, 3], in_one_task=data.draw(st.integers(3, 12)))
    got = got.toPandas().sort_values("k").set_index("k")
    ordered = pdf.sort_values(["t", "k"])
    for p in (1, 3):
        want = ordered.groupby("g").v.shift(p)
        np.testing.assert_allclose(got[f"v_lag_{p}_by_g"].to_numpy(dtype=float), want.sort_index().to_numpy())


def test_lag_with_missing_order_over_cuts(spark):
    pdf = pd.DataFrame({"k": range(40), "g": ["a"] * 40, "v": np.arange(40.0)})
    order = F.when(F.col("k") % 4 != 0, F.col("k") % 9).alias("t")
    df = spark.createDataFrame(pdf).select("*", order)
    want = rows_by(groups.lag_features(df, "g", ["v"], ["t", "k"], [1, 2]), "k")
    assert rows_by(groups.lag_features(df, "g", ["v"], ["t", "k"], [1, 2], in_one_task=6), "k") == want


def test_salted_join_spreads_equal_rows(spark):
    df = spark.range(4000).select(F.lit(5).alias("k")).repartition(16)
    table = spark.createDataFrame([(5, "x")], "k int, v string")
    joined = attach(df, Lookup(table, False), ["k"])
    assert joined.where("v = 'x'").count() == 4000
    assert "__salt" in joined._jdf.queryExecution().toString()


def test_lag_of_null_group_is_null(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "a", 3.0), (4, "a", 4.0)], "t int, g string, v double")
    for limit in (1, 100):
        out = rows_by(groups.lag_features(df, "g", ["v"], ["t"], [1], in_one_task=limit), "t")
        assert [out[t]["v_lag_1_by_g"] for t in (1, 2, 3, 4)] == [None, None, None, 3.0]


def test_row_statistics_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (None, 2.0, None)], "a double, b double, c double")
    out = df.select(*[e.alias(n) for n, e in row_statistics(["a", "b", "c"]).items()]).collect()
    assert out[0]["numeric_mean"] == 2.5 and out[0]["numeric_std"] == pytest.approx(np.std([1, 4], ddof=1))
    assert out[0]["numeric_range"] == 3.0
    assert all(v is None for v in out[1])
    assert out[2]["numeric_mean"] == 2.0 and out[2]["numeric_std"] is None


def test_numeric_gates(spark):
    rows = [(float(v), float(i), -float(i), float(i % 2)) for i, v in enumerate([1, 1, 1, 2, 50])]
    df = spark.createDataFrame(rows, "skewed double, up double, down double, flag double")
    made = numeric.fit_numeric_features(df, df.columns).columns
    assert "skewed_log" in made and "up_log" not in made
    assert "skewed_squared" in made and "up_sqrt" in made and "down_sqrt" not in made
    assert numeric.fit_numeric_features(df, ["up"]).columns == {}


def test_products_and_polynomials_are_bounded(spark):
    df = spark.range(9).select(*[(F.col("id") * i + i).cast("double").alias(f"c{i}") for i in range(1, 13)])
    assert len(numeric.fit_products(df, df.columns).columns) == 10
    assert len(numeric.fit_polynomial(df, df.columns).columns) == 45
    assert list(numeric.fit_polynomial(df, ["c1", "c2"], 3).columns) == ["poly_c1 c2", "poly_c1^2 c2", "poly_c1 c2^2"]


def test_ratio_of_zero_keeps_going(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -1e-8)], "a double, b double")
    out = [r["a_div_b"] for r in numeric.ratios(["a", "b"]).transform(df).collect()]
    assert out[0] == pytest.approx(1e8) and out[1] is None


def test_scaling_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r["x"] for r in numeric.fit_standard_scaling(df, ["x"]).transform(df).collect()} == {0.0}
    assert {r["x"] for r in numeric.fit_robust_scaling(df, ["x"]).transform(df).collect()} == {0.0}


def test_align_adds_and_drops(spark):
    df = spark.createDataFrame([(1, 2)], "b int, z int")
    assert [tuple(r) for r in align_to(df, ["a", "b"]).collect()] == [(0, 1)]


def test_cluster_distances(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fitted = reduce.fit_clusters(lines, ["l_quantity", "l_extendedprice"], k=3)
    out = fitted.transform(lines.select("l_quantity", "l_extendedprice")).toPandas()
    far = out[[f"dist_to_cluster_{i}" for i in range(3)]].to_numpy()
    assert (far.argmin(axis=1) == out["cluster"].to_numpy()).all()
    point = out[["l_quantity", "l_extendedprice"]].to_numpy()
    np.testing.assert_allclose(far[:, 0], np.linalg.norm(point - np.array(fitted.centres[0]), axis=1))


def test_component_scores_are_uncorrelated(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fitted = reduce.fit_components(lines, ["l_quantity", "l_extendedprice", "l_tax"], k=3)
    scores = fitted.transform(lines).select("pca_0", "pca_1", "pca_2").toPandas()
    cov = np.cov(scores.to_numpy().T)
    assert abs(scores.mean()).max() < 1e-6 * scores.std().max()
    assert abs(cov - np.diag(np.diag(cov))).max() < 1e-6 * cov.max()


def test_binned_mi_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"good": y + rng.normal(0, 0.3, 400), "noise": rng.normal(size=400), "y": y})
    got = {r["feature"]: r["mi"] for r in select.mutual_information(spark.createDataFrame(pdf), ["good", "noise"], "y", 5).collect()}
    for f in ("good", "noise"):
        edges = np.quantile(pdf[f], [0.2, 0.4, 0.6, 0.8])
        cells = pd.crosstab(np.searchsorted(edges, pdf[f], side="left"), pdf.y).to_numpy() / 400
        outer = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True)
        want = np.sum(np.where(cells > 0, cells * np.log(np.where(cells > 0, cells, 1) / outer), 0))
        assert got[f] == pytest.approx(want)
    assert got["good"] > 10 * got["noise"]
    chosen = select.select_features(spark.createDataFrame(pdf.assign(tag="t")), "y", max_features=2)
    assert chosen == ["good", "tag"]


def test_prepared_table_is_literal_or_written(spark):
    table = spark.range(10).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert "LocalTableScan" in prepare(table).table._jdf.queryExecution().toString()
    assert "FileScan parquet" in prepare(table, max_rows=3).table._jdf.queryExecution().toString()


def test_log_query_where_no_log_is_made(spark, tmp_path):
    from __spark_entry__ import queries

    # Skewed, but with a zero: the gate makes no column.
    rows = [(k, float(k % 7 == 0) * k, k % 3) for k in range(50)] + [(50, None, 1)]
    spark.createDataFrame(rows, "event_id long, value double, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    made = queries()["fe_log"](spark, str(tmp_path))
    assert made.columns == ["event_id", "value", "user_id", "value_log"]
    assert made.count() == 51 and made.where("value_log is not null").isEmpty()
    assert made.schema["value_log"].dataType.typeName() == "double"
