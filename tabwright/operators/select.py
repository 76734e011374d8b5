"""Feature selection by binned mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, quoted, string_columns
from ..functions.quantiles import quantile_values
from .schema import FEW_VALUES, target_facts

BINS = 10


def bin_index(c: str, edges: Sequence[float]) -> Column:
    """How many of the sorted edges lie below the value: 0 .. len(edges)."""
    x = quoted(c).cast("double")
    index = F.lit(0)
    for e in sorted(set(edges)):
        index = index + (x > e).cast("int")
    return index


def mutual_information(
    train: DataFrame, features: Sequence[str], target: str, bins: int = BINS, numeric_target: bool | None = None
) -> DataFrame:
    """``(feature, mi)`` in nats between quantile bins of each feature and the target.

    One pass counts (feature, bin, class) cells; all that follows is a few cells
    per feature. A numeric target is binned like a feature.
    """
    features = list(features)
    if numeric_target is None:
        numeric_target = is_numeric_target(train, target)
    probs = [i / bins for i in range(1, bins)]
    binned = [*features, target] if numeric_target else features
    edges = quantile_values(train, binned, probs)
    label = bin_index(target, edges[target]) if numeric_target else quoted(target)
    cells = (
        train.select(
            label.cast("string").alias("cls"),
            *[bin_index(f, edges[f] or []).alias(f) for f in features],
        )
        .unpivot(["cls"], features, "feature", "bin")
        .where(F.col("bin").isNotNull() & F.col("cls").isNotNull())
        .groupBy("feature", "bin", "cls")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("feature"))
    per_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    per_class = F.sum("n").over(Window.partitionBy("feature", "cls"))
    share = cells.select("feature", "n", total.alias("t"), per_bin.alias("b"), per_class.alias("c"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
    return share.groupBy("feature").agg(F.sum(term).alias("mi"))


def is_numeric_target(train: DataFrame, target: str) -> bool:
    if target in string_columns(train):
        return False
    return target_facts(train, target).first()["n_unique"] >= FEW_VALUES


def select_features(
    train: DataFrame,
    target: str,
    max_features: int | None = None,
    threshold: float = 0.0,
    keep: Sequence[str] = (),
    bins: int = BINS,
) -> list[str]:
    """Feature names: informative numbers by score, then everything not scored.

    ``keep`` names columns such as one-hot flags that are never scored.
    """
    numbers = [c for c in numeric_columns(train) if c != target and c not in set(keep)]
    others = [c for c in train.columns if c != target and c not in numbers]
    scored = mutual_information(train, numbers, target, bins) if numbers else None
    found = (
        [r["feature"] for r in scored.where(F.col("mi") > threshold).orderBy(F.desc("mi"), "feature").collect()]
        if scored is not None
        else []
    )
    chosen = found + others
    if max_features and len(chosen) > max_features:
        room = max_features - len(others)
        chosen = found[:room] + others if room > 0 else chosen[:max_features]
    return chosen
