"""Fitted flows in a folder, by version: a flow is loaded by another session as it was saved.

A version is a folder with the lookup tables of the steps as parquet and, written last, a
manifest with every step's kind and parameters. A folder without a manifest does not count, so
a save that broke off leaves no half version behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import Lookup
from ..operators.encode import CategoricalEncoding, CountEncoding, LabelEncoding, OneHotEncoding, TargetEncoding
from ..operators.groups import GroupStatistics, LagFeatures
from ..operators.impute import Imputation
from ..operators.numeric import Clipping, Derived, Scaling, Term
from ..operators.reduce import ClusterFeatures, ComponentFeatures
from ..operators.saved import read_manifest, write_manifest
from .feature_flow import DateFeatures, FittedFlow, InputColumns, KeepColumns


@dataclass
class _Folder:
    """Writes and reads the lookup tables of one version."""

    spark: SparkSession
    path: str
    written: int = 0
    seen: dict[int, dict] = field(default_factory=dict)

    def put(self, lookup: Lookup) -> dict:
        if id(lookup.table) not in self.seen:
            name = f"table{self.written}"
            self.written += 1
            lookup.table.write.parquet(f"{self.path}/{name}")
            self.seen[id(lookup.table)] = {"table": name, "small": lookup.small}
        return self.seen[id(lookup.table)]

    def get(self, found: dict) -> Lookup:
        table = self.spark.read.parquet(f"{self.path}/{found['table']}")
        if found["small"]:
            # Its rows and bytes were within their bounds when it was fitted.
            table = self.spark.createDataFrame(table.toArrow(), schema=table.schema)
        return Lookup(table, found["small"])

    def put_all(self, some: dict[str, Lookup]) -> list:
        return [[n, self.put(x)] for n, x in some.items()]

    def get_all(self, found: list) -> dict[str, Lookup]:
        return {n: self.get(x) for n, x in found}


def _plain(*names: str) -> tuple[Callable, Callable]:
    """A step whose attributes are plain values."""

    def dump(step: object, _: _Folder) -> dict:
        return {n: getattr(step, n) for n in names}

    def load(kind: type, found: dict, _: _Folder) -> object:
        return kind(**{n: found[n] for n in names})

    return dump, load


def _pairs(name: str) -> tuple[Callable, Callable]:
    """A step with one dictionary of pairs of numbers."""

    def load(kind: type, found: dict, _: _Folder) -> object:
        return kind({c: tuple(v) for c, v in found[name].items()})

    return _plain(name)[0], load


def _dump_target(s: TargetEncoding, out: _Folder) -> dict:
    return {"by_fold": out.put_all(s.by_fold), "by_value": out.put_all(s.by_value), "fold": s.fold, "overall": s.overall}


def _load_target(kind: type, f: dict, at: _Folder) -> TargetEncoding:
    return kind(at.get_all(f["by_fold"]), at.get_all(f["by_value"]), f["fold"], f["overall"])


def _dump_counts(s: CountEncoding, out: _Folder) -> dict:
    return {"tables": out.put_all(s.tables), "suffix": s.suffix, "drop": s.drop_source}


def _load_counts(kind: type, f: dict, at: _Folder) -> CountEncoding:
    return kind(at.get_all(f["tables"]), f["suffix"], f["drop"])


def _dump_categories(s: CategoricalEncoding, out: _Folder) -> dict:
    return {"label": s.label.classes, "one_hot": s.one_hot.categories, "counts": _dump_counts(s.counts, out)}


def _load_categories(kind: type, f: dict, at: _Folder) -> CategoricalEncoding:
    return kind(LabelEncoding(f["label"]), OneHotEncoding(f["one_hot"]), _load_counts(CountEncoding, f["counts"], at))


def _load_terms(kind: type, f: dict, _: _Folder) -> Derived:
    return kind({n: Term(op, tuple(of)) for n, op, of in f["terms"]})


# How each kind of step is written and read.
STEPS: dict[type, tuple[Callable, Callable]] = {
    InputColumns: _plain("columns", "beside"),
    KeepColumns: _plain("columns", "beside"),
    DateFeatures: _plain("columns", "text"),
    Imputation: _plain("drop", "flag", "fill"),
    LabelEncoding: _plain("classes"),
    OneHotEncoding: _plain("categories"),
    LagFeatures: _plain("group", "columns", "order", "periods"),
    ClusterFeatures: _plain("columns", "centres"),
    ComponentFeatures: _plain("columns", "means", "loadings", "explained"),
    Scaling: _pairs("params"),
    Clipping: _pairs("bounds"),
    Derived: (lambda s, _: {"terms": [[n, t.op, list(t.of)] for n, t in s.terms.items()]}, _load_terms),
    CountEncoding: (_dump_counts, _load_counts),
    TargetEncoding: (_dump_target, _load_target),
    CategoricalEncoding: (_dump_categories, _load_categories),
    GroupStatistics: (lambda s, out: {"tables": out.put_all(s.tables)}, lambda kind, f, at: kind(at.get_all(f["tables"]))),
}


@dataclass
class FlowStore:
    """Versions of a fitted flow under one folder that every executor can reach."""

    spark: SparkSession
    root: str

    def versions(self) -> DataFrame:
        """``version, folder, steps, features`` of every finished version."""
        try:
            lines = self.spark.read.text(f"{self.root}/*/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "version int, folder string, steps int, features int")
        fields = F.from_json("value", "version int, folder string, steps array<string>, features array<string>")
        return lines.select(fields.alias("m")).select(
            "m.version", "m.folder", F.size("m.steps").alias("steps"), F.size("m.features").alias("features")
        )

    def save(self, flow: FittedFlow) -> int:
        """Write a flow as the next version and return its number."""
        last = self.versions().agg(F.max("version").alias("v")).first()["v"] or 0
        folder = f"v{last + 1:06d}-{uuid.uuid4().hex[:8]}"
        out = _Folder(self.spark, f"{self.root}/{folder}")
        steps = []
        for step in flow.steps:
            if type(step) not in STEPS:
                raise TypeError(f"cannot save a step of kind {type(step).__name__}")
            steps.append({"kind": type(step).__name__, "params": STEPS[type(step)][0](step, out)})
        content = {"version": last + 1, "folder": folder, "steps": steps, "features": flow.features}
        write_manifest(self.spark, out.path, content)
        return last + 1

    def load(self, version: int | None = None) -> FittedFlow:
        """The flow of a version, the latest by default; of two saved at once under one number, the later name."""
        found = self.versions() if version is None else self.versions().where(F.col("version") == version)
        best = found.agg(F.max(F.struct("version", "folder")).alias("m")).first()["m"]
        if best is None:
            raise ValueError(f"no such version under {self.root}")
        at = _Folder(self.spark, f"{self.root}/{best['folder']}")
        content = read_manifest(self.spark, at.path)
        kinds = {k.__name__: k for k in STEPS}
        steps = [STEPS[kinds[s["kind"]]][1](kinds[s["kind"]], s["params"], at) for s in content["steps"]]
        return FittedFlow(steps, content["features"])
