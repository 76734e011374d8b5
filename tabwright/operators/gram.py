"""Ridge fits for every penalty and every set of held-out folds from one scan.

A least-squares fit needs nothing but sums of products. They are kept per fold, around the
means of the whole table; the sums of any set of folds are added up on the driver, where a
fit is one small linear system and the squared error of a fold is a quadratic form.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beyond this the products of a row no longer fit one compiled aggregation.
MAX_WIDTH = 48


@dataclass
class LinearFit:
    """A linear model as literals: ``intercept + coefficients . features``."""

    intercept: float
    coefficients: list[float]

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        value = F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + F.lit(float(self.intercept))
        return table.select(*table.columns, value.alias(name))

    def importances(self, features: Sequence[str]) -> dict[str, float]:
        return {}


@dataclass
class FoldMoments:
    """Per fold: rows, sums and products of ``(features, y)`` less ``centre``."""

    centre: np.ndarray
    rows: dict[int, float]
    sums: dict[int, np.ndarray]
    products: dict[int, np.ndarray]

    def of(self, folds: Iterable[int]) -> tuple[float, np.ndarray, np.ndarray]:
        some = [k for k in folds if k in self.rows]
        width = len(self.centre)
        return (
            sum(self.rows[k] for k in some),
            sum((self.sums[k] for k in some), np.zeros(width)),
            sum((self.products[k] for k in some), np.zeros((width, width))),
        )

    def of_places(self, places: Sequence[int] | None) -> FoldMoments:
        """The moments of some of the features (all of them, if none are named)."""
        if places is None:
            return self
        at = [*places, len(self.centre) - 1]
        return FoldMoments(
            self.centre[at],
            self.rows,
            {k: v[at] for k, v in self.sums.items()},
            {k: v[np.ix_(at, at)] for k, v in self.products.items()},
        )

    def ridge(self, folds: Iterable[int], alpha: float) -> LinearFit:
        """Squared error plus ``alpha`` times the squared coefficients, the intercept free."""
        n, sums, products = self.of(folds)
        if not n:
            raise ValueError("no rows to fit on")
        mean = sums / n
        about = products - n * np.outer(mean, mean)
        p = len(mean) - 1
        w = np.linalg.solve(about[:p, :p] + alpha * np.eye(p), about[:p, p]) if p else np.zeros(0)
        at = mean + self.centre
        return LinearFit(float(at[p] - w @ at[:p]), [float(v) for v in w])

    def squared_error(self, fold: int, fit: LinearFit) -> float | None:
        """Mean squared error on a fold without reading its rows; None for an empty fold."""
        n, sums, products = self.of([fold])
        if not n:
            return None
        v = np.array([*(-c for c in fit.coefficients), 1.0])
        shift = float(v @ self.centre) - fit.intercept
        return float((v @ products @ v + 2 * shift * (v @ sums) + n * shift * shift) / n)


def fold_moments(table: DataFrame, fold: str = "fold") -> FoldMoments:
    """Two scans of ``(features, y, fold)``: the centre, then the sums of each fold."""
    first = table.agg(Summarizer.mean(F.col("features")).alias("x"), F.avg("y").alias("y")).first()
    centre = np.array([*(first["x"].toArray() if first["x"] is not None else []), first["y"] or 0.0])
    width = len(centre)
    x = vector_to_array("features")
    values = [F.get(x, F.lit(i)) for i in range(width - 1)] + [F.col("y")]
    moved = table.select(F.col(fold).alias("fold"), *[(v - F.lit(float(c))).alias(f"d{i}") for i, (v, c) in enumerate(zip(values, centre, strict=True))])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    found = moved.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"d{i}").alias(f"s{i}") for i in range(width)],
        *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    out = FoldMoments(centre, {}, {}, {})
    for r in found.collect():  # one row per fold
        k, products = r["fold"], np.zeros((width, width))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out.rows[k], out.sums[k], out.products[k] = float(r["n"]), np.array([r[f"s{i}"] for i in range(width)]), products
    return out
