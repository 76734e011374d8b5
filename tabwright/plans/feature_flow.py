"""The whole feature flow: fitted on train, applied to any table or stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import align_to, numeric_columns, quoted
from ..functions.scalar import date_cycles, date_parts
from ..operators.encode import fit_categorical_encoding, fit_frequency_encoding, fit_target_encoding
from ..operators.folds import FOLDS, fold_by_hash
from ..operators.groups import SIMPLE_STATS, LagFeatures, fit_group_statistics
from ..operators.impute import fit_imputation
from ..operators.numeric import (
    Derived,
    fit_numeric_features,
    fit_polynomial,
    fit_products,
    fit_standard_scaling,
    ratios,
    row_features,
    scalable_columns,
)
from ..operators.reduce import fit_clusters, fit_components
from ..operators.schema import semantic_types, simple_types
from ..operators.select import select_features
from ..session import cut_lineage

# Gates of the advanced features.
CLUSTER_MIN = 2
COMPONENT_MIN = 3
POLY_MAX = 5


class Step(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass
class DateFeatures:
    """Calendar parts and cycles; the source columns go."""

    columns: list[str]
    text: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        parsed = {c: F.try_to_timestamp(quoted(c)).alias(c) for c in self.text}
        df = df.select(*[parsed.get(c, quoted(c)) for c in df.columns])
        made = [e.alias(n) for c in self.columns for n, e in {**date_parts(c), **date_cycles(c)}.items()]
        return df.select(*[quoted(c) for c in df.columns if c not in self.columns], *made)


@dataclass
class InputColumns:
    """The raw columns the flow was fitted on, in order; a missing one is an error."""

    columns: list[str]
    beside: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        there = [c for c in self.beside if c in df.columns]
        return align_to(df, [*there, *self.columns])


@dataclass
class KeepColumns:
    """The selected features in order; missing ones become 0, others go."""

    columns: list[str]
    beside: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        there = [c for c in self.beside if c in df.columns]
        return align_to(df, [*there, *self.columns])


@dataclass
class FittedFlow:
    steps: list[Step]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Works on batch and streaming tables; the target may be absent."""
        for step in self.steps:
            df = step.transform(df)
        return df


@dataclass
class FeatureFlow:
    """Impute, dates, groups, numeric, encode, products, row statistics, scale, advanced, select.

    On request: statistics of the numbers by each of ``groups``, lags of the numbers by
    ``lag_by = (group, order)`` (a batch step: ``order`` is an input column led by a number or a
    time), and ``with_ratios`` of every pair of numbers.
    """

    key: str
    target: str | None = None
    advanced: bool = False
    select: bool = True
    max_features: int | None = None
    scale: bool = True
    target_means: Sequence[str] = ()
    folds: int = FOLDS
    groups: Sequence[str] = ()
    lag_by: tuple[str, str] | None = None
    lag_periods: Sequence[int] = (1, 2, 3)
    with_ratios: bool = False

    def column_roles(self, train: DataFrame) -> dict[str, list[str]]:
        """Numeric, categorical and datetime columns; keys, ids and the target are none of them."""
        beside = {self.key, self.target}
        table = train.drop(*[c for c in beside if c])
        roles: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "datetime_text": [], "id": [], "text": []}
        kinds = {r["column"]: r["semantic_type"] for r in semantic_types(table).collect()}
        dated = {r["column"] for r in simple_types(table).where("simple_type = 'datetime'").collect()}
        for f in table.schema.fields:
            kind = kinds.get(f.name, "categorical")
            if f.name in dated and isinstance(f.dataType, T.StringType):
                kind = "datetime_text"
            # All values differ in a continuous measure too: that alone makes no id.
            elif kind == "id" and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                kind = "numeric"
            elif kind == "id" and f.name in dated:
                kind = "datetime"
            roles[kind].append(f.name)
        return roles

    def fit(self, train: DataFrame) -> FittedFlow:
        return self.fit_transform(train)[0]

    def fit_transform(self, train: DataFrame) -> tuple[FittedFlow, DataFrame]:
        roles = self.column_roles(train)
        dates = [*roles["datetime"], *roles["datetime_text"]]
        steps: list[Step] = []
        beside = [c for c in (self.key, self.target) if c]
        used = [c for c in (*roles["numeric"], *roles["categorical"], *dates) if c not in beside]
        table = train.select(*[quoted(c) for c in (*beside, *used)])

        def add(step: Step) -> None:
            nonlocal table
            steps.append(step)
            fitted_on_train = getattr(step, "transform_train", step.transform)
            table = fitted_on_train(table)

        add(InputColumns(used, beside))
        add(fit_imputation(table, used))
        measures = [c for c in roles["numeric"] if c in table.columns]
        if self.lag_by:
            group, order = self.lag_by
            lagged = [c for c in measures if c not in (group, order)]
            add(LagFeatures(group, lagged, [order, self.key], list(self.lag_periods)))
        if groups := [c for c in self.groups if c in table.columns]:
            add(fit_group_statistics(table, groups, measures, SIMPLE_STATS))
        if dates:
            add(DateFeatures(dates, roles["datetime_text"]))
        numbers = [c for c in roles["numeric"] if c in table.columns]
        categories = [c for c in roles["categorical"] if c in table.columns]
        add(fit_numeric_features(table, numbers))
        if self.with_ratios:
            # Products come below.
            add(Derived({n: t for n, t in ratios(numbers).terms.items() if t.op == "ratio"}))
        if self.advanced and categories:
            add(fit_frequency_encoding(table, categories))
        means = [c for c in self.target_means if c in categories]
        if means and self.target:
            table = fold_by_hash(table, [self.key], self.folds)
            add(fit_target_encoding(table, means, self.target))
            table = table.drop("fold")
        encoding = fit_categorical_encoding(table, categories)
        add(encoding)
        # Everything fitted from here on reads this table several times.
        table = cut_lineage(table)
        add(fit_products(table, numbers))
        add(row_features(numbers))
        if self.advanced:
            if len(numbers) >= CLUSTER_MIN:
                add(fit_clusters(table, numbers))
            if len(numbers) >= COMPONENT_MIN:
                add(fit_components(table, numbers))
            if len(numbers) <= POLY_MAX:
                add(fit_polynomial(table, numbers))
        if self.scale:
            add(fit_standard_scaling(table, scalable_columns(table, numeric_columns(table, beside))))
        if self.select and self.target:
            flags = [n for n in encoding.generated if n not in {f"{c}_count" for c in categories}]
            chosen = select_features(table.drop(self.key), self.target, self.max_features, keep=flags)
        else:
            chosen = [c for c in table.columns if c not in beside]
        add(KeepColumns(chosen, beside))
        return FittedFlow(steps, chosen), table
