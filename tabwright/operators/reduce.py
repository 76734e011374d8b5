"""Cluster and principal-component features from Spark ML fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import per_column, quoted

CLUSTERS = 5
COMPONENTS = 5
SEED = 42
#: Rows of a part that the fit keeps: a split of a packed file holds many times its size in vectors.
PART_ROWS = 1_000_000


def _filled(c: str) -> Column:
    return F.coalesce(quoted(c).cast("double"), F.lit(0.0))


def _vectors(df: DataFrame, exprs: Sequence[Column]) -> DataFrame:
    names = [f"x{i}" for i in range(len(exprs))]
    table = df.select(*[e.alias(n) for e, n in zip(exprs, names, strict=True)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(table).select("features")


def _dealt(vectors: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``vectors`` in parts of about ``part_rows`` rows, however few splits they are read from."""
    parts = -(-vectors.count() // part_rows)
    return vectors.repartition(parts) if parts > 1 else vectors


@dataclass
class ClusterFeatures:
    """Nearest centre and the distance to every centre, as plain expressions."""

    columns: list[str]
    centres: list[list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.centres:
            return df
        k = len(self.centres)
        names = [f"dist_to_cluster_{i}" for i in range(k)]

        def distance(centre: Sequence[float]) -> Column:
            gaps = [_filled(c) - F.lit(float(v)) for c, v in zip(self.columns, centre, strict=True)]
            return F.sqrt(reduce(Column.__add__, [g * g for g in gaps]))

        far = df.select("*", *[distance(v).alias(n) for v, n in zip(self.centres, names, strict=True)])
        nearest = F.array_position(F.array(*names), F.least(*names)) if k > 1 else F.lit(1)
        return far.withColumn("cluster", (nearest - 1).cast("int"))


def fit_clusters(
    train: DataFrame, columns: Sequence[str], k: int = CLUSTERS, seed: int = SEED
) -> ClusterFeatures:
    columns = list(columns)
    if len(columns) < 2:
        return ClusterFeatures(columns, [])
    # The fit keeps its own copy of the vectors while it iterates.
    model = KMeans(k=k, seed=seed).fit(_dealt(_vectors(train, [_filled(c) for c in columns])))
    return ClusterFeatures(columns, [list(map(float, v)) for v in model.clusterCenters()])


@dataclass
class ComponentFeatures:
    """Centred scores on the leading principal components."""

    columns: list[str]
    means: list[float]
    loadings: list[list[float]]
    explained: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        def score(weights: Sequence[float]) -> Column:
            terms = [
                (_filled(c) - F.lit(m)) * F.lit(float(w))
                for c, m, w in zip(self.columns, self.means, weights, strict=True)
            ]
            return reduce(Column.__add__, terms)

        return df.select("*", *[score(w).alias(f"pca_{i}") for i, w in enumerate(self.loadings)])


def fit_components(train: DataFrame, columns: Sequence[str], k: int = COMPONENTS) -> ComponentFeatures:
    """The sign of each component is fixed so that its largest loading is positive."""
    columns = list(columns)
    k = min(k, len(columns))
    means = {
        r["column"]: r["m"]
        for r in per_column(train, columns, lambda c: {"m": F.avg(_filled(c))}).collect()
    }
    centred = _vectors(train, [_filled(c) - F.lit(means[c]) for c in columns])
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(centred)
    matrix = model.pc.toArray()
    loadings = []
    for j in range(k):
        column = [float(v) for v in matrix[:, j]]
        sign = 1.0 if max(column, key=abs) >= 0 else -1.0
        loadings.append([sign * v for v in column])
    explained = [float(v) for v in model.explainedVariance]
    return ComponentFeatures(columns, [means[c] for c in columns], loadings, explained)
