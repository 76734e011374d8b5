"""Attach a fitted table to rows by key, whatever the sizes and the skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted
from .sizing import MAX_ROWS, settle

PIECES_PER_PARTITION = 4


@dataclass
class Lookup:
    """A fitted table, unique on its key: a measured small literal, or a written table."""

    table: DataFrame
    small: bool


def prepare(table: DataFrame, max_rows: int = MAX_ROWS) -> Lookup:
    """Compute a fitted table once: small ones are kept as literals, others written."""
    return Lookup(*settle(table, max_rows))


def attach(
    df: DataFrame,
    lookup: Lookup,
    on: Sequence[str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Left join a fitted table; misses take ``defaults``.

    A table measured to be small is broadcast. A larger one is shuffled with the
    hot keys of ``df`` salted.
    """
    on = list(on)
    table = lookup.table
    if lookup.small:
        joined = df.join(F.broadcast(table), on, "left")
    elif df.isStreaming:
        # A micro-batch is small, and its hot keys cannot be counted beforehand.
        joined = df.join(table, on, "left")
    else:
        joined = _salted_left(df, table, on)
    # The key columns lead after a join by name; keep the caller's order.
    added = [c for c in table.columns if c not in on]
    fill = dict(defaults or {})
    return joined.select(
        *[quoted(c) for c in df.columns],
        *[F.coalesce(quoted(c), F.lit(fill[c])).alias(c) if c in fill else quoted(c) for c in added],
    )


def hot_keys(df: DataFrame, on: Sequence[str], pieces: int) -> DataFrame:
    """Keys holding more than 1/pieces of the rows, with the salts each needs.

    There are fewer than ``pieces`` such keys, and their salts are fewer than twice
    that together.
    """
    known = df.dropna(subset=list(on))
    sizes = known.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    salts = F.ceil(F.col("n") * pieces / F.lit(max(total, 1))).cast("int")
    found = sizes.where(F.col("n") * pieces > total).select(*on, salts.alias("__salts")).toArrow()
    schema = T.StructType([*df.select(*on).schema.fields, T.StructField("__salts", T.IntegerType())])
    return df.sparkSession.createDataFrame(found, schema=schema)


def row_hash(df: DataFrame) -> Column:
    """A hash of the row and its input split: spreads equal rows, stable on retry."""
    hashed = [
        quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.xxhash64(*hashed, F.spark_partition_id())


def _salted_left(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a hot key go to several tasks, and its table row is copied to each."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = PIECES_PER_PARTITION * partitions
    hot = F.broadcast(hot_keys(df, on, pieces))
    no_key = ~_all_present(on)
    # Rows without a key match nothing, so they may go anywhere.
    salts = F.when(no_key, F.lit(pieces)).otherwise(F.coalesce(F.col("__salts"), F.lit(1)))
    rows = df.withColumn("__hash", row_hash(df)).join(hot, on, "left")
    rows = rows.withColumn("__salt", F.pmod(F.col("__hash"), salts).cast("int")).drop("__salts", "__hash")
    last = F.coalesce(F.col("__salts"), F.lit(1)) - 1
    copies = table.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return rows.join(copies.drop("__salts"), [*on, "__salt"], "left").drop("__salt")


def _all_present(on: Sequence[str]) -> Column:
    present = F.lit(True)
    for c in on:
        present = present & quoted(c).isNotNull()
    return present


def join_on_key(left: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Put columns of several tables side by side by their unique row key.

    A key that only some tables have keeps its row, with NULLs for the others. A key
    that a table holds twice raises an error when the rows are read.
    """
    single = [_unique(t, key) for t in (left, *others)]
    out = single[0]
    for other in single[1:]:
        out = out.join(other, key, "full")
    return out


def _unique(table: DataFrame, key: str) -> DataFrame:
    """``table``, checked while it is grouped by its key."""
    rest = [c for c in table.columns if c != key]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(
        F.first(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(True))
    )
    grouped = table.groupBy(key).agg(once.alias("__row"))
    return grouped.select(key, *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(rest)])
