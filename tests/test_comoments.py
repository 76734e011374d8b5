"""Correlations of any number of columns with gaps, pair by pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tabwright.functions.comoments import pair_moments
from tabwright.functions.columns import nan_to_null
from tabwright.operators import profile


def found(df, columns=None):
    return {(r["feature1"], r["feature2"]): r["corr"] for r in profile.correlations(df, columns).collect()}


def two_pass(x, y):
    here = ~(np.isnan(x) | np.isnan(y))
    x, y = x[here].astype(np.longdouble), y[here].astype(np.longdouble)
    if len(x) < 2:
        return None
    dx, dy = x - x.mean(), y - y.mean()
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float((dx @ dy) / np.sqrt((dx @ dx) * (dy @ dy)))


def awkward(rows=600, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=rows)
    hole = rng.random(rows) < 0.3
    pdf = pd.DataFrame(
        {
            "plain": base,
            "far": base + 1e9,
            "outliers": np.where(hole, 1e14, base + rng.normal(size=rows)),
            "partner": np.where(hole, np.nan, base),
            "two_levels": np.where(rng.random(rows) < 0.5, base, 1e11 + base),
            "constant": np.full(rows, 0.1),
            "nearly_constant": np.where(hole, 3.0, 0.1),
            "gone": np.full(rows, np.nan),
            "tiny": base * 1e-150,
            "once": np.where(np.arange(rows) == 7, 2.0, np.nan),
        }
    )
    pdf["low_only"] = np.where(pdf.two_levels < 1e10, np.nan, rng.normal(size=rows) + base)
    return pdf


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("parts", [1, 7])
def test_every_pair_equals_two_passes(spark, monkeypatch, block, parts):
    monkeypatch.setattr("tabwright.functions.comoments.pair_moments.__defaults__", (block,))
    pdf = awkward()
    got = found(nan_to_null(spark.createDataFrame(pdf).repartition(parts)))
    names = list(pdf.columns)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), r in got.items():
        want = two_pass(pdf[a].to_numpy(), pdf[b].to_numpy())
        loose = 1e-4 if {a, b} & {"far", "two_levels"} else 1e-9
        assert (r is None) == (want is None) and (r is None or r == pytest.approx(want, abs=loose)), (a, b, r, want)


def test_other_columns_do_not_change_a_pair(spark):
    pdf = awkward()
    some = ["plain", "outliers", "partner"]
    df = nan_to_null(spark.createDataFrame(pdf))
    few, many = found(df, some), found(df)
    assert all(few[k] == pytest.approx(many[k], abs=1e-12) for k in few)


def test_many_columns_by_blocks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(80, 300)), columns=[f"c{i}" for i in range(300)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    df = nan_to_null(spark.createDataFrame(pdf))
    moments = pair_moments(df, list(pdf.columns), block=128)
    assert moments.count() == 300 * 299 // 2
    want, got = pdf.corr(), found(df)
    picked = [("c0", "c299"), ("c127", "c128"), ("c5", "c6"), ("c200", "c260")]
    assert all(got[k] == pytest.approx(want.loc[k]) for k in picked)


def test_empty_tables_and_infinite_values(spark):
    assert found(spark.createDataFrame([], "a double, b double, s string")) == {("a", "b"): None}
    assert found(spark.createDataFrame([(1.0,)], "a double")) == {}
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("inf"), 2.0), (4.0, 3.0, None), (5.0, None, 1.0)], "a double, b double, `c.d` double")
    got = found(df)
    assert np.isnan(got[("a", "b")]) and np.isnan(got[("b", "c.d")]) and got[("a", "c.d")] is not None
