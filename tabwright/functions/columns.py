"""Schema-driven column picking and the long form used by the profilers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
DIGEST_LENGTH = 64
WIDE = 12


def quoted(c: str) -> Column:
    """A column by its exact name, which may hold dots and other signs."""
    return F.col("`" + c.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def drop_strings(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drop string columns left over before modelling."""
    return df.drop(*string_columns(df, exclude=keep))


def split_target(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target beside its row key."""
    return df.drop(target), df.select(key, target)


def align_to(df: DataFrame, columns: Sequence[str], fill: float = 0) -> DataFrame:
    """Exactly ``columns`` in order: missing ones become ``fill``, others go."""
    have = set(df.columns)
    return df.select(*[quoted(c) if c in have else F.lit(fill).alias(c) for c in columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in float columns at ingest; NULL from here on."""
    return df.select(
        *[
            F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, _FLOATING)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def per_column(
    df: DataFrame, columns: Sequence[str], make: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """One output row per column, all from a single aggregation over ``df``."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"), *[e.alias(n) for n, e in make(c).items()]
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def numeric_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to ``(by..., column, value double)``."""
    if set(columns) & set(by):
        raise ValueError("a column cannot be both a group and a value")
    picked = df.select(*by, *[quoted(c).cast("double").alias(c) for c in columns])
    return picked.unpivot([quoted(b) for b in by], [quoted(c) for c in columns], "column", "value")


def per_numeric_column(
    df: DataFrame, columns: Sequence[str], make: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """``per_column`` for statistics that treat every column as doubles.

    Many columns in one aggregation fall out of code generation; they are unpivoted
    and grouped by their name instead, still in one scan. A row without a value per
    column makes sure that an empty table has its row for every column, too, so
    statistics must skip NULLs.
    """
    if len(columns) <= WIDE:
        return per_column(df, columns, make)
    stats = [e.alias(n) for n, e in make("value").items()]
    named = df.sparkSession.createDataFrame([(c, None) for c in columns], "column string, value double")
    return numeric_long(df, columns).unionByName(named).groupBy("column").agg(*stats)


def typed_long(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Unpivot columns of any type to ``(column, value)``, one table per type class.

    Counting distinct values then neither rounds large integers nor prints
    doubles. A long text is replaced by its 256-bit digest, so that whole documents
    need not be shuffled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    longs = [c for c in columns if isinstance(kinds[c], _INTEGRAL)]
    doubles = [c for c in columns if isinstance(kinds[c], _FLOATING)]
    others = [c for c in columns if c not in longs and c not in doubles]

    def text(c: str) -> Column:
        plain = quoted(c).cast("string")
        # A digest is longer than any text left as it is.
        return F.when(F.length(plain) < DIGEST_LENGTH, plain).otherwise(F.sha2(plain, 256))

    def unpivoted(names: list[str], value: Callable[[str], Column]) -> DataFrame:
        return df.select(*[value(c).alias(c) for c in names]).unpivot([], [quoted(c) for c in names], "column", "value")

    made = []
    if longs:
        made.append(unpivoted(longs, lambda c: quoted(c).cast("bigint")))
    if doubles:
        made.append(unpivoted(doubles, lambda c: quoted(c).cast("double")))
    if others:
        made.append(unpivoted(others, text))
    return made
