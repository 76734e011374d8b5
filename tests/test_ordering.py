"""Ranges over several order columns, and what is computed range by range."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions import ordering
from tabwright.operators.folds import stratified_folds
from tabwright.operators.groups import lag_features
from tabwright.operators.trials import running_best


def check_ranges(df, order, limit):
    """Ranges hold at most ``limit`` rows, but for rows equal in all order columns, and rise with the order."""
    cut = ordering.split_ranges(df, order, limit).orderBy(*order).collect()
    ranges = [r["__range"] for r in cut]
    assert ranges == sorted(ranges)
    held = {}
    for r in cut:
        held.setdefault(r["__range"], []).append(tuple(str(v + 0.0 if isinstance(v, float) else v) for v in (r[c] for c in order)))
    for rows in held.values():
        assert len(rows) <= limit or len(set(rows)) == 1, (len(rows), set(rows))
    return held


def mixed_rows(n=900):
    rng = random.Random(4)
    stamp = dt.datetime(2024, 1, 1, 12)
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, 5e-324]
    texts = [None, "", "a", "a\0", "a\0\0", "ab", "prefix-that-is-shared-by-many", "é", "z" * 40]
    return [
        (
            i,
            stamp if i % 3 else stamp + dt.timedelta(microseconds=i),
            rng.choice(values) if i % 2 else rng.random(),
            rng.choice(texts) if i % 2 else "prefix-that-is-shared-by-many-" + "x" * rng.randrange(12) + str(i % 50),
            dt.date(2024, 1, 1) + dt.timedelta(days=i % 4) if i % 5 else None,
            i % 2 == 0 if i % 7 else None,
        )
        for i in range(n)
    ]


SCHEMA = "id long, t timestamp, x double, s string, d date, b boolean"


@pytest.mark.parametrize(
    "order", [["x", "id"], ["d", "b", "s", "x", "id"], ["b", "t"], ["u", "x"], ["m", "id"]]
)
def test_ranges_keep_the_order_and_the_limit(spark, order):
    df = spark.createDataFrame(mixed_rows(), SCHEMA).repartition(5)
    df = df.withColumns({"u": F.col("t").cast("timestamp_ntz"), "m": (F.col("id") % 9).cast("decimal(30,4)")})
    if "m" in order:
        # More digits than a double holds: its ties stay together rather than being cut wrongly.
        ranges = [r["__range"] for r in ordering.split_ranges(df, order, 20).orderBy(*order).collect()]
        assert ranges == sorted(ranges) and len(set(ranges)) >= 9
        return
    assert len(check_ranges(df, order, 20)) > 4


def test_one_repeated_timestamp_is_cut_by_the_next_column(spark):
    df = spark.range(6000).select(F.lit(dt.datetime(2024, 5, 1)).alias("t"), (F.col("id") * 7 % 6000).alias("k"))
    held = check_ranges(df, ["t", "k"], 100)
    assert len(held) >= 60


def test_many_ranges(spark):
    df = spark.range(45_000).select((F.col("id") * 37 % 45_000).alias("v"))
    cut = ordering.split_ranges(df, ["v"], 2)
    sizes = cut.groupBy("__range").count().agg(F.max("count").alias("m"), F.count("*").alias("n")).first()
    assert sizes["m"] <= 2 and sizes["n"] > 20_000


def test_totals_lags_folds_and_bests_with_tied_leading_columns(spark):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1 + i // 400), float(i * 31 % 97)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g int, t timestamp, v double").repartition(4)
    order = ["t", "id"]
    few, many = (
        {r["id"]: r["s"] for r in ordering.running_total(df, ["g"], order, F.col("v"), "s", in_one_task=n).collect()} for n in (10**6, 40)
    )
    assert few == many
    few, many = (
        sorted(map(str, lag_features(df, "g", ["v"], order, in_one_task=n).collect())) for n in (10**6, 40)
    )
    assert few == many
    few, many = ({r["id"]: r["fold"] for r in stratified_folds(df, "g", "id", in_one_task=n).collect()} for n in (10**6, 40))
    assert few == many
    few, many = (sorted(map(str, running_best(df, "id", "v", in_one_task=n).collect())) for n in (10**6, 40))
    assert few == many
