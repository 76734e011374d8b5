"""Categorical encodings fitted on train and attached by join, never by lookup UDF."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import per_column, quoted
from ..functions.lookup import Lookup, attach, prepare
from ..functions.sizing import MAX_ROWS
from .profile import distinct_counts, value_counts

# Which encoding a number of distinct values gets.
LABEL_VALUES = 2
ONE_HOT_MAX_VALUES = 10
UNSEEN_LABEL = -1
_KEY = "__attached_value"


def prepared_counts(
    train: DataFrame, columns: Sequence[str], max_rows: int = MAX_ROWS
) -> dict[str, Lookup]:
    """One ``(value, n)`` table per column from a single pass over train."""
    every = prepare(value_counts(train, columns), max_rows)
    return {
        c: Lookup(every.table.where(F.col("column") == c).select("value", "n"), every.small)
        for c in columns
    }


def _attach_value(df: DataFrame, column: str, lookup: Lookup, name: str, default: object) -> DataFrame:
    """Attach ``lookup(value, name)`` by the string value of ``column``."""
    key = _KEY
    keyed = df.withColumn(key, quoted(column).cast("string"))
    table = Lookup(lookup.table.withColumnRenamed("value", key), lookup.small)
    return attach(keyed, table, [key], {name: default}).drop(key)


@dataclass
class CountEncoding:
    """``{c}_count`` (or ``{c}_freq``, the share of non-null rows); unseen values get 0."""

    tables: dict[str, Lookup]
    suffix: str
    drop_source: bool

    def transform(self, df: DataFrame) -> DataFrame:
        default = 0.0 if self.suffix == "freq" else 0
        for c, lookup in self.tables.items():
            df = _attach_value(df, c, lookup, f"{c}_{self.suffix}", default)
        return df.drop(*self.tables) if self.drop_source else df


def fit_count_encoding(
    train: DataFrame, columns: Sequence[str], drop_source: bool = True, max_rows: int = MAX_ROWS
) -> CountEncoding:
    tables = {
        c: Lookup(t.table.select("value", F.col("n").alias(f"{c}_count")), t.small)
        for c, t in prepared_counts(train, columns, max_rows).items()
    }
    return CountEncoding(tables, "count", drop_source)


def fit_frequency_encoding(
    train: DataFrame, columns: Sequence[str], max_rows: int = MAX_ROWS
) -> CountEncoding:
    present = {
        r["column"]: r["n"]
        for r in per_column(train, columns, lambda c: {"n": F.count(quoted(c))}).collect()
    }
    tables = {
        c: Lookup(
            t.table.select("value", (F.col("n") / F.lit(present[c] or 1)).alias(f"{c}_freq")), t.small
        )
        for c, t in prepared_counts(train, columns, max_rows).items()
    }
    return CountEncoding(tables, "freq", drop_source=False)


def few_categories(train: DataFrame, columns: Sequence[str], at_most: int) -> dict[str, list[str]]:
    """Sorted categories per column; ``at_most + 1`` entries where there are more."""
    order = Window.partitionBy("column").orderBy("value")
    rows = (
        value_counts(train, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= at_most + 1)
        .collect()
    )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["column"]].append(r["value"])
    return found


@dataclass
class LabelEncoding:
    """Sorted classes become 0, 1, ...; unseen values get -1."""

    classes: dict[str, list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        def code(c: str) -> Column:
            known = F.array(*[F.lit(v) for v in self.classes[c]])
            place = F.array_position(known, quoted(c).cast("string"))
            return (F.coalesce(place, F.lit(0)) - 1).cast("int").alias(c)

        return df.select(*[code(c) if c in self.classes else quoted(c) for c in df.columns])


def fit_label_encoding(
    train: DataFrame, columns: Sequence[str], at_most: int = LABEL_VALUES
) -> LabelEncoding:
    found = few_categories(train, columns, at_most)
    wide = [c for c, values in found.items() if len(values) > at_most]
    if wide:
        raise ValueError(f"more than {at_most} classes in {', '.join(wide)}")
    return LabelEncoding(found)


@dataclass
class OneHotEncoding:
    """One 0/1 column per train category and one for NULL; the source column goes."""

    categories: dict[str, list[str]]

    def names(self, c: str) -> list[str]:
        """A name per category, then one for NULL that no category has."""
        values = set(self.categories[c])
        null = "nan"
        while null in values:
            null = f"null_{null}"
        return [f"{c}_{v}" for v in self.categories[c]] + [f"{c}_{null}"]

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [quoted(c) for c in df.columns if c not in self.categories]
        flags = []
        for c, values in self.categories.items():
            text = quoted(c).cast("string")
            hits = [F.coalesce(text == v, F.lit(False)) for v in values] + [quoted(c).isNull()]
            flags += [h.cast("int").alias(n) for h, n in zip(hits, self.names(c), strict=True)]
        return df.select(*kept, *flags)


def fit_one_hot(
    train: DataFrame, columns: Sequence[str], at_most: int = ONE_HOT_MAX_VALUES
) -> OneHotEncoding:
    found = few_categories(train, columns, at_most)
    wide = [c for c, values in found.items() if len(values) > at_most]
    if wide:
        raise ValueError(f"more than {at_most} categories in {', '.join(wide)}")
    return OneHotEncoding(found)


@dataclass
class TargetEncoding:
    """Out-of-fold target means for train, full-train means for other tables."""

    by_fold: dict[str, Lookup]
    by_value: dict[str, Lookup]
    fold: str
    overall: float

    def transform_train(self, train: DataFrame) -> DataFrame:
        for c, lookup in self.by_fold.items():
            keyed = train.withColumn(_KEY, quoted(c))
            train = attach(keyed, lookup, [_KEY, self.fold], {f"{c}_target_enc": self.overall}).drop(_KEY)
        return train

    def transform(self, df: DataFrame) -> DataFrame:
        for c, lookup in self.by_value.items():
            keyed = df.withColumn(_KEY, quoted(c))
            df = attach(keyed, lookup, [_KEY], {f"{c}_target_enc": self.overall}).drop(_KEY)
        return df


def fit_target_encoding(
    train: DataFrame,
    columns: Sequence[str],
    target: str,
    fold: str = "fold",
    max_rows: int = MAX_ROWS,
) -> TargetEncoding:
    """One aggregation per column by (value, fold).

    A fold's mean is the total without that fold; the window over a value sees
    at most one row per fold.
    """
    y = quoted(target).cast("double")
    overall = train.agg(F.avg(y).alias("m")).first()["m"]
    by_fold, by_value = {}, {}
    for c in columns:
        name = f"{c}_target_enc"
        sums = prepare(
            train.where(quoted(c).isNotNull())
            .groupBy(quoted(c).alias(_KEY), fold)
            .agg(F.sum(y).alias("s"), F.count(y).alias("n")),
            max_rows,
        )
        whole = Window.partitionBy(_KEY)
        rest_n = F.sum("n").over(whole) - F.col("n")
        rest_s = F.sum("s").over(whole) - F.coalesce(F.col("s"), F.lit(0.0))
        mean = F.when(rest_n > 0, rest_s / F.nullif(rest_n, F.lit(0)))
        by_fold[c] = Lookup(sums.table.select(_KEY, fold, mean.alias(name)), sums.small)
        total_n = F.sum("n")
        mean = F.when(total_n > 0, F.sum("s") / F.nullif(total_n, F.lit(0)))
        by_value[c] = Lookup(sums.table.groupBy(_KEY).agg(mean.alias(name)), sums.small)
    return TargetEncoding(by_fold, by_value, fold, overall)


@dataclass
class CategoricalEncoding:
    """Label, one-hot or count encoding per column by its number of distinct values."""

    label: LabelEncoding
    one_hot: OneHotEncoding
    counts: CountEncoding


    def transform(self, df: DataFrame) -> DataFrame:
        return self.counts.transform(self.one_hot.transform(self.label.transform(df)))

    @property
    def generated(self) -> list[str]:
        hot = [n for c in self.one_hot.categories for n in self.one_hot.names(c)]
        return hot + [f"{c}_count" for c in self.counts.tables]


def fit_categorical_encoding(train: DataFrame, columns: Sequence[str]) -> CategoricalEncoding:
    columns = list(columns)
    found = few_categories(train, columns, ONE_HOT_MAX_VALUES) if columns else {}
    label = {c: v for c, v in found.items() if len(v) == LABEL_VALUES}
    hot = {c: v for c, v in found.items() if len(v) <= ONE_HOT_MAX_VALUES and c not in label}
    wide = [c for c in columns if c not in label and c not in hot]
    counts = fit_count_encoding(train, wide) if wide else CountEncoding({}, "count", True)
    return CategoricalEncoding(LabelEncoding(label), OneHotEncoding(hot), counts)
