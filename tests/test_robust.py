"""Cases at the edges: empty and wide tables, infinite values, odd names, gaps in keys."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import lookup, ordering, quantiles, sizing
from tabwright.functions.columns import per_numeric_column
from tabwright.functions.moments import skew
from tabwright.operators import blend, impute, metrics, models, profile, quality
from tabwright.operators.encode import OneHotEncoding
from tabwright.operators.models import CLASSIFICATION, Learner
from tabwright.plans.feature_flow import FeatureFlow


def same(a, b):
    return all(x == pytest.approx(y) or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def test_both_quantile_plans_agree_on_odd_values(spark):
    rng = random.Random(3)
    odd = [math.inf, -math.inf, math.nan, None, 5e-324, 0.0, -0.0, 1e308, -1e308]
    rows = [(rng.gauss(0, 1), rng.choice(odd), math.inf, 5e-324 * (k % 3), 10.0 ** (k % 300)) for k in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    small = {r["column"]: r["q"] for r in quantiles.quantiles(df, df.columns, probs).collect()}
    large = {r["column"]: r["q"] for r in quantiles.quantiles(df, df.columns, probs, in_one_task=0).collect()}
    assert set(small) == set(large) == set(df.columns)
    assert all(same(small[c], large[c]) for c in df.columns)
    assert small["c"] == [math.inf] * 6


def test_quantiles_of_wide_and_empty_tables(spark):
    names = [f"c{k}" for k in range(200)]
    wide = spark.range(50).select(*[(F.col("id") * (k + 1)).cast("double").alias(c) for k, c in enumerate(names)])
    for limit in (1, 10**9):
        got = quantiles.quantile_values(wide, names, [0.5], limit)
        assert got["c199"] == [24.5 * 200]
        assert not any((quantiles.quantile_values(wide.limit(0), names, [0.5], limit)).values())


@pytest.mark.parametrize("n", [12, 13])
def test_empty_tables_have_a_row_per_column(spark, n):
    names = [f"c{k}" for k in range(n)]
    empty = spark.range(0).select(*[F.col("id").cast("double").alias(c) for c in names])
    got = per_numeric_column(empty, names, lambda c: {"n": F.count(c), "skew": skew(c)}).collect()
    assert sorted((r["column"], r["n"]) for r in got) == sorted((c, 0) for c in names)


def test_reports_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert profile.missing_values(empty).count() == 0
    assert {r["outliers_pct"] for r in profile.distributions(empty).collect()} == {None}
    assert {r["warn_missing"] for r in quality.quality_report(empty).collect()} == {False}
    assert impute.missing_shares(empty, ["a", "b"]) == {}


def test_many_pairs_with_gaps_correlate_as_pairs(spark):
    rng = random.Random(11)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(10**k, 2) for k in range(8)) + (7.0 if r % 3 else None,) for r in range(200)]
    names = [f"c{k}" for k in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(r["feature1"], r["feature2"]): r["corr"] for r in profile.correlations(df).collect()}
    want = df.toPandas().corr()
    assert len(got) == 36
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b]) if r is not None else math.isnan(want.loc[a, b])


def test_many_ranges_are_even(spark):
    df = spark.range(40_000).select((F.col("id") * 37 % 40_000).alias("v"))
    cut = ordering.with_range(df, "v", ordering.range_edges(df, "v", 4000), "r")
    sizes = [r["count"] for r in cut.groupBy("r").count().collect()]
    assert len(sizes) > 2000 and max(sizes) <= 60


def test_measured_tables(spark):
    table = spark.range(100).select(F.col("id"), F.lit("x" * 100).alias("text"))
    for rows, size, small in ((100, 1 << 20, True), (99, 1 << 20, False), (100, 5000, False), (0, 1 << 20, False)):
        kept, fits = sizing.settle(table, rows, size)
        assert fits is small
        assert kept.count() == 100
    plan = lookup.prepare(table, 10).table._jdf.queryExecution().toString()
    assert "parquet" in plan.lower()


def test_rows_that_one_model_did_not_score_stay(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, a double")
    b = spark.createDataFrame([(2, 0.3), (3, 0.4)], "id long, `b.1` double")
    got = {r["id"]: tuple(r)[1:] for r in lookup.join_on_key(a, b, key="id").collect()}
    assert got == {1: (0.1, None), 2: (0.2, 0.3), 3: (None, 0.4)}
    with pytest.raises(Exception, match="not unique"):
        lookup.join_on_key(a.union(a), b, key="id").collect()


def test_folds_out_of_range_are_an_error(spark):
    rows = [(k, k % 2, k % 5, float(k)) for k in range(20)]
    table = spark.createDataFrame(rows, "id long, y int, fold int, x double")
    ready = models.feature_table(table, "id", ["x"], "y", ["fold"])
    with pytest.raises(ValueError, match="8 rows"):
        models.oof_predictions(ready, {"l": Learner("logistic")}, CLASSIFICATION, folds=3)


def test_flow_with_odd_names_and_missing_inputs(spark):
    kinds = ["v1.0", "St. John", "nan", "a`b", None]
    rows = [(k, float(k % 7), float(k), kinds[k % 5], k % 2) for k in range(60)]
    train = spark.createDataFrame(rows, "id long, `size.a` double, w double, kind string, y int")
    flow, made = FeatureFlow("id", "y", select=False).fit_transform(train)
    assert {"kind_v1.0", "kind_St. John", "kind_nan", "kind_null_nan"} <= set(made.columns)
    again = flow.transform(train.drop("y"))
    assert again.count() == 60
    assert again.agg(F.sum(F.col("`kind_null_nan`"))).first()[0] == pytest.approx(
        made.agg(F.sum(F.col("`kind_null_nan`"))).first()[0]
    )
    with pytest.raises(ValueError, match="w"):
        flow.transform(train.drop("w"))


def test_names_of_null_flags():
    assert OneHotEncoding({"c": ["nan", "null_nan"]}).names("c") == ["c_nan", "c_null_nan", "c_null_null_nan"]


def test_weights_of_perfect_models(spark):
    assert blend.score_weights({"a": 0.0, "b": 2.0}, errors=True) == {"a": 1.0, "b": 0.0}
    assert blend.score_weights({"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5}
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "model string, importance double")
    assert blend.importance_weights(flat, ["a", "b"]) == {"a": 0.5, "b": 0.5}


def test_best_weights_equal_a_full_search(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        y = k % 3 == 0
        rows.append((int(y), *(min(max(rng.gauss(0.5 + 0.1 * (j + 1) * y, 0.3), 0.0), 1.0) for j in range(3))))
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    tried = blend.random_weights(3)
    assert len(tried) == 200 and all(sum(w) == pytest.approx(1) for w in tried)
    every = {r["candidate"]: r["auc"] for r in blend.search_weights_auc(df, "y", ["a", "b", "c"], tried).collect()}
    best = blend.best_weights_auc(df, "y", ["a", "b", "c"]).first()
    assert best["auc"] == pytest.approx(max(every.values()))
    assert list(best["weights"]) == pytest.approx(tried[best["candidate"]])
    own = metrics.auc_scores(blend.weighted(df, dict(zip("abc", best["weights"], strict=True)), "e"), "y", ["e"])
    assert own.first()["auc"] == pytest.approx(best["auc"])
    one = blend.best_weights_mse(df, "y", ["a", "b", "c"]).first()
    all_mse = blend.search_weights_mse(df, "y", ["a", "b", "c"], tried).agg(F.min("mse")).first()[0]
    assert one["mse"] == all_mse


def test_exact_auc_over_many_ranges(spark):
    from tabwright.operators.weight_auc import exact_auc

    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 1, None]), rng.choice([0.25, 0.5, rng.random(), None]), rng.choice([rng.gauss(0, 1), float("nan"), 0.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(7)
    tried = [(3, [1.0, 0.0]), (5, [0.0, 1.0]), (8, [0.5, 0.5])]

    def won(p: float, n: float) -> float:
        if math.isnan(p) or math.isnan(n):
            return 0.5 if math.isnan(p) and math.isnan(n) else float(math.isnan(p))
        return 0.5 if p == n else float(p > n)

    for range_rows in (10, 200, 5000):
        found = {r["candidate"]: r["auc"] for r in exact_auc(df, "y", ["a", "b"], tried, len(rows), range_rows).collect()}
        for k, (u, v) in tried:
            by = {t: [u * a + v * b for y, a, b in rows if y == t and a is not None] for t in (0, 1)}
            want = sum(won(p, n) for p in by[1] for n in by[0]) / (len(by[0]) * len(by[1]))
            assert found[k] == pytest.approx(want, abs=1e-12)


def test_best_weights_with_missing_and_infinite_scores(spark):
    """Once an error: a score that is no number has no bin."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, nan, 0.0), (0, -inf, 0.5), (1, 0.7, 0.2), (0, 0.1, 0.3), (0, None, 0.1), (None, 0.5, 0.5), (1, inf, 0.4)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    best = blend.best_weights_auc(df, "y", ["a", "b"], [[0.1, 0.9], [0.9, 0.1]]).first()
    assert best["candidate"] == 1 and best["auc"] == 1.0
    alone = blend.best_weights_auc(df.where("y = 1"), "y", ["a", "b"], [[0.1, 0.9], [0.9, 0.1]]).first()
    assert alone["candidate"] == 0 and alone["auc"] is None
    assert blend.best_weights_auc(df.where("y = 7"), "y", ["a", "b"]).count() == 0


def _aucs(rows, tried):
    """AUC of every weight vector, pair by pair."""
    y, xs = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]).T
    found = []
    for w in tried:
        total = xs[0] * w[0]
        for x, v in zip(xs[1:], w[1:], strict=True):
            total = total + x * v
        p, n = total[y == 1][:, None], total[y == 0][None, :]
        found.append(float((p > n).mean() + (p == n).mean() / 2))
    return found


def test_best_weights_deal_few_scores_at_a_time(spark, monkeypatch):
    """Near-equal candidates were once all dealt at once: 9 GB of shuffle files for 54 million rows."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.random(), rng.randint(0, 96) / 97, rng.randint(0, 10) / 11) for _ in range(2000)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(5)
    every, dealt, exact = _aucs(rows, blend.random_weights(3)), [], blend.exact_auc

    def recorded(df, y, predictions, candidates, *given, **named):
        dealt.append(len(candidates))
        return exact(df, y, predictions, candidates, *given, **named)

    monkeypatch.setattr(blend, "exact_auc", recorded)
    monkeypatch.setattr(blend, "AT_ONCE", 0, raising=False)
    for bins in (1024, 8):
        dealt.clear()
        best = blend.best_weights_auc(df, "y", ["a", "b", "c"], bins=bins).first()
        assert best["auc"] == pytest.approx(max(every), abs=1e-12)
        assert every[best["candidate"]] == pytest.approx(max(every), abs=1e-12)
        assert max(dealt) <= 3


@pytest.mark.parametrize("at_once", [0, 10**9])
def test_best_weights_among_equals_are_the_first(spark, monkeypatch, at_once):
    """Few levels stay in doubt however fine the bins; of equal AUC the first counts."""
    rng = random.Random(6)
    noise = [(k % 2, rng.randint(0, 2) / 2, rng.randint(0, 2) / 2) for k in range(300)]
    apart = [(k % 2, k % 2 + rng.random() / 4, k % 2 + rng.random() / 4) for k in range(200)]
    monkeypatch.setattr(blend, "AT_ONCE", at_once, raising=False)
    tried = [[0.0, 1.0], [0.5, 0.5], [1.0, 0.0], [0.25, 0.75], [0.75, 0.25], [1.0, 0.0], [0.5, 0.5]]
    for rows in (noise, [(y, -a, -b) for y, a, b in noise], apart, [(1 - y, a, b) for y, a, b in apart]):
        df = spark.createDataFrame(rows, "y int, a double, b double")
        every = _aucs(rows, tried)
        for bins in (2, 1024):
            best = blend.best_weights_auc(df, "y", ["a", "b"], tried, bins=bins).first()
            assert (best["candidate"], best["auc"]) == (every.index(max(every)), pytest.approx(max(every), abs=1e-12))
            assert list(best["weights"]) == tried[best["candidate"]]


def test_class_counts_bound_the_auc_by_pieces(spark):
    from tabwright.operators.weight_auc import PIECE, class_counts

    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.random(), rng.choice([0.5, rng.random()])) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(3)
    tried, cut = [(2, [1.0, 0.0]), (9, [0.5, 0.5]), (4, [0.0, 1.0])], {2: 10, 9: 5 * PIECE + 3, 4: PIECE}
    found = {r["candidate"]: r for r in class_counts(df, "y", ["a", "b"], tried, 0.0, 1.0, cut).collect()}
    for k, (u, v) in tried:
        at = [(y, int(min((u * a + v * b) * cut[k], cut[k] - 1))) for y, a, b in rows]
        below = sum(p > n for t, p in at if t for s, n in at if not s)
        tied = sum(p == n for t, p in at if t for s, n in at if not s)
        r = found[k]
        assert (r["pos"], r["neg"]) == (sum(t for t, _ in at), sum(1 - t for t, _ in at))
        assert (r["least"], r["most"]) == (below, below + tied)


def test_shuffle_files_go_when_a_query_ends(spark):
    import time
    from pathlib import Path

    from tabwright.session import shuffles_freed

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files() -> set[str]:
        return {p.name for d in dirs for p in Path(str(d)).glob("*/shuffle_*.data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting, None), files()
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.random(), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(4)
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark), shuffles_freed(spark):
        assert spark.conf.get(setting) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(setting, None) == was
    blend.best_weights_auc(df, "y", ["a", "b"])
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(setting, None) == was


def test_folds_are_united_from_files(spark):
    """Each fold once made the table anew, with all its shuffles."""
    made = spark.range(200).groupBy((F.col("id") % 40).alias("k")).agg(F.avg("id").alias("x"))
    table = models.with_folds(models.feature_table(made.withColumn("y", F.col("x") * 2), "k", ["x"], "y"), 3)
    held = models.oof_predictions(table, {"ridge": Learner("ridge")}, "regression", 3)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and held.count() == 40


def test_cluster_vectors_are_dealt_into_parts(spark):
    from tabwright.operators.reduce import _dealt

    one = spark.range(1000).coalesce(1)
    sizes = [r["n"] for r in _dealt(one, 100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10
    assert _dealt(one, 1000).rdd.getNumPartitions() == 1


def test_scaling_statistics_work_out_few_columns_at_once(spark):
    from tabwright.operators import numeric

    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(14)])
    assert numeric.scalable_columns(df) == [f"c{i}" for i in range(14)]
    found = numeric.fit_standard_scaling(df, df.columns).params
    assert found["c13"][0] == pytest.approx(24.5 * 14) and len(found) == 14
    rows = numeric._by_few(df, df.columns, lambda c: {"n": F.count(c)})
    assert [r["column"] for r in rows] == df.columns
