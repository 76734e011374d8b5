"""Fold assignment from the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.ordering import IN_ONE_TASK, numbered

SEED = 42
FOLDS = 5


def fold_by_key(df: DataFrame, key: str, k: int = FOLDS) -> DataFrame:
    """``fold = key mod k``: no shuffle, for keys that are already well mixed."""
    return df.withColumn("fold", F.pmod(quoted(key), F.lit(k)).cast("int"))


def fold_by_hash(df: DataFrame, keys: Sequence[str], k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """A shuffled fold: the same row gets the same fold in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*map(quoted, keys), F.lit(seed)), F.lit(k)).cast("int"))


def stratified_folds(
    df: DataFrame,
    target: str,
    key: str,
    k: int = FOLDS,
    shuffle_seed: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Folds that split every class evenly, dealing rows in key (or hashed key) order."""
    order = F.col(key) if shuffle_seed is None else F.xxhash64(key, F.lit(shuffle_seed))
    placed = numbered(df.withColumn("__order", order), [target], ["__order", key], "__place", in_one_task)
    return placed.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__order", "__place")
