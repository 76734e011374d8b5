"""Nested cross-fitting: predictions by models that saw neither a row's fold nor the held ones.

``CrossFit.predictions(learner, held)`` are predictions for the rows of the folds ``held`` by
``learner`` trained on all other folds. A base learner is fitted for that. Whatever learns from
predictions does so on the rows of the other folds, each predicted with ``held`` and its own
fold held out: a stack fits its meta learners there, a blend finds its weights, a search its
parameters. So nothing of a held row reaches what predicts it, at any depth.

All of them read one store, keyed by learner, parameters, table and held folds. A fit with the
folds 1 and 3 held out serves row 1 when 3 is held and row 3 when 1 is, and every contestant
that asks for it. A level of stacking needs sets of one more fold.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import row_mean, weighted_sum
from ..session import cut_lineage, new_shared_path
from .blend import TOP, best_weights_auc, best_weights_mse, score_weights
from .gram import MAX_WIDTH, FoldMoments, fold_moments
from .metrics import fold_scores
from .models import CLASSIFICATION, RIDGE_ALPHA, CustomLearner, Learner, _check_binary, _together
from .stacking import FittedStack, FittedVote, StackLearner

Held = tuple[int, ...]
BLENDS = ("vote", "score", "top", "good", "search")
_FACTS = "id string, held array<int>, learner string, table string, seconds double, facts map<string,double>"


@dataclass(frozen=True)
class Blend:
    """A weighted mean of learners: ``vote`` equal weights, ``score`` by score (1/error), ``top`` the
    five best by score, ``good`` those at or above the median score, ``search`` the best of 200 random weights."""

    learners: Mapping[str, object]
    kind: str = "score"


@dataclass(frozen=True)
class Search:
    """An algorithm with the best of drawn parameter sets; ties go to the first."""

    algorithm: str
    drawn: Sequence[Mapping[str, object]]


@dataclass(frozen=True)
class Subspace:
    """A learner that sees some of the features, by their places."""

    learner: object
    places: Sequence[int]

    def fit(self, table: DataFrame, task: str) -> FittedSubspace:
        return FittedSubspace(self.learner.fit(_sliced(table, self.places), task), list(self.places))


@dataclass
class FittedSubspace:
    fitted: object
    places: list[int]

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        kept = table.columns
        made = self.fitted.predict(_sliced(table.withColumn("__whole", F.col("features")), self.places), name)
        return made.drop("features").withColumnRenamed("__whole", "features").select(*kept, name)

    def importances(self, features: Sequence[str]) -> dict[str, float]:
        return self.fitted.importances([features[i] for i in self.places])


def _sliced(table: DataFrame, places: Sequence[int]) -> DataFrame:
    slicer = VectorSlicer(inputCol="features", outputCol="__some", indices=list(places))
    return slicer.transform(table).drop("features").withColumnRenamed("__some", "features")


def describe(learner: object) -> dict:
    """What tells learners of different results apart."""

    def all_of(learners: Mapping[str, object]) -> list:
        return [[n, describe(x)] for n, x in learners.items()]

    if isinstance(learner, Learner):
        return {"algorithm": learner.algorithm, "params": dict(learner.params)}
    if isinstance(learner, CustomLearner):
        found = learner.estimator.extractParamMap()
        return {"estimator": type(learner.estimator).__name__, "params": {p.name: str(v) for p, v in found.items()}}
    if isinstance(learner, Subspace):
        return {"places": list(learner.places), "learner": describe(learner.learner)}
    if isinstance(learner, StackLearner):
        return {"stack": all_of(learner.learners), "meta": all_of(learner.meta), "top": learner.top_features}
    if isinstance(learner, Blend):
        return {"blend": all_of(learner.learners), "kind": learner.kind}
    if isinstance(learner, Search):
        return {"search": learner.algorithm, "drawn": [dict(d) for d in learner.drawn]}
    raise TypeError(f"no description of {type(learner).__name__}")


@dataclass
class PredictionStore:
    """Finished predictions under one folder; those of an earlier session are found again.

    Each entry has its predictions and, written after them, one row of facts. Without the
    facts an entry does not count, so a fit that broke off is made again.
    """

    spark: SparkSession
    root: str
    known: dict[tuple[str, Held], dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = {(r["id"], tuple(r["held"])): r.asDict() for r in self._found()}

    def _found(self) -> list:
        try:
            return self.entries().collect()  # one row per fit
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def entries(self) -> DataFrame:
        """``id, held, learner, table, seconds, facts`` of everything stored."""
        return self.spark.read.schema(_FACTS).parquet(f"{self.root}/*/*/facts")

    def _path(self, name: str, held: Held) -> str:
        return f"{self.root}/{name}/{'_'.join(map(str, held))}"

    def predictions(self, name: str, held: Held, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self._path(name, held)}/rows")

    def add(self, name: str, held: Held, learner: str, table: str, rows: DataFrame, facts: Mapping[str, float]) -> None:
        start = time.time()
        rows.write.mode("overwrite").parquet(f"{self._path(name, held)}/rows")
        row = (name, list(held), learner, table, time.time() - start, {k: float(v) for k, v in facts.items()})
        one = self.spark.createDataFrame([row], _FACTS)
        one.write.mode("overwrite").parquet(f"{self._path(name, held)}/facts")
        self.known[name, held] = one.first().asDict()


class CrossFit:
    """Nested predictions over one table ``(key, features, y, fold)``; keys are unique.

    Folds are ``0 .. folds - 1``. The table is written once; ``store`` names a folder that
    keeps predictions for later sessions (a new one by default).
    """

    def __init__(self, table: DataFrame, task: str, folds: int, store: str | None = None, parallelism: int = 4) -> None:
        self.spark, self.task, self.folds, self.parallelism = table.sparkSession, task, tuple(range(folds)), parallelism
        self.rows = cut_lineage(table.select("key", "features", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")))
        self.schema = self.rows.select("key", "fold", "y").schema.add("value", "double")
        self._check(folds)
        self.errors = task != CLASSIFICATION
        self.store = PredictionStore(self.spark, store or new_shared_path(self.spark, "predictions"))
        self.table_id = self._fingerprint()
        self.width = len(self.rows.select("features").first()[0]) if self.rows.take(1) else 0
        self._moments: FoldMoments | None = None
        self._final: dict[str, object] = {}

    def _check(self, folds: int) -> None:
        inside = F.coalesce(F.col("fold").between(0, folds - 1), F.lit(False))
        if outside := self.rows.agg(F.count_if(~inside).alias("n")).first()["n"]:
            raise ValueError(f"{outside} rows have a fold outside 0 to {folds - 1}")
        if not self.rows.groupBy("key").count().where("count > 1").isEmpty():
            raise ValueError("a key stands in two rows")
        _check_binary(self.rows, self.task)

    def _fingerprint(self) -> str:
        """Of the rows, in any order; features are hashed by their values."""
        h = F.xxhash64("key", "y", "fold", vector_to_array("features"))
        r = self.rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s")).first()
        return f"{r['n']}.{r['x']}.{r['s']}"

    def identity(self, learner: object) -> tuple[str, str]:
        text = json.dumps(describe(learner), sort_keys=True, default=str)
        whole = f"{text}|{self.task}|{self.table_id}|{len(self.folds)}"
        return hashlib.sha256(whole.encode()).hexdigest()[:24], text

    # Predictions

    def predictions(self, learner: object, held: Sequence[int]) -> DataFrame:
        """``key, fold, y, value`` of the rows of ``held``, by the learner trained on the other folds."""
        held = tuple(sorted(held))
        if self._from_moments(learner):
            return self._made(self._fit(learner, self._rest(held)), held)
        name, text = self.identity(learner)
        if (name, held) not in self.store.known:
            rows, facts = self._make(learner, held)
            self.store.add(name, held, text, self.table_id, rows, facts)
        return self.store.predictions(name, held, self.schema)

    def facts(self, learner: object, held: Sequence[int]) -> dict[str, float]:
        """What was fitted beside the predictions: importances, weights or the chosen parameter set."""
        if self._from_moments(learner):
            return {}
        self.predictions(learner, held)
        return self.store.known[self.identity(learner)[0], tuple(sorted(held))]["facts"]

    def held_out(self, learner: object) -> DataFrame:
        """Every row predicted with its own fold held out."""
        return reduce(DataFrame.unionByName, [self.predictions(learner, (k,)) for k in self.folds])

    def inputs(self, learners: Mapping[str, object], folds: Sequence[int], held: Held, prefix: str = "") -> DataFrame:
        """``key, fold, y`` and a column per learner: rows of ``folds``, with ``held`` and their own fold held out."""
        parts = []
        for k in folds:
            for n, learner in learners.items():
                found = self.predictions(learner, {*held, k}).where(F.col("fold") == k)
                parts.append(found.withColumn("name", F.lit(prefix + n)))
        long = reduce(DataFrame.unionByName, parts)
        values = [F.max(F.when(F.col("name") == prefix + n, F.col("value"))).alias(prefix + n) for n in learners]
        return long.groupBy("key", "fold", "y").agg(*values)

    def prepare(self, contestants: Mapping[str, object], held: Sequence[Held] | None = None) -> int:
        """Fit side by side every base learner that the contestants ask for; how many were fitted."""
        wanted: dict[tuple[str, Held], object] = {}
        for learner in contestants.values():
            for h in [(k,) for k in self.folds] if held is None else held:
                self._needs(learner, h, wanted)
        missing = [(x, key[1]) for key, x in wanted.items() if key not in self.store.known]
        cached = self.rows.persist()
        try:
            _together(self.spark, [lambda x=x, h=h: self.predictions(x, h) for x, h in missing], self.parallelism)
        finally:
            cached.unpersist()
        return len(missing)

    def _needs(self, learner: object, held: Held, wanted: dict) -> None:
        members = self._members(learner)
        if self._from_moments(learner) or isinstance(learner, Search) and self._by_moments(learner):
            return
        if members is None:
            wanted[self.identity(learner)[0], held] = learner
            return
        for x in members.values():
            for k in self.folds:
                if k not in held:
                    self._needs(x, tuple(sorted({*held, k})), wanted)
            if held and not isinstance(learner, Search):
                self._needs(x, held, wanted)

    @staticmethod
    def _members(learner: object) -> Mapping[str, object] | None:
        if isinstance(learner, (StackLearner, Blend)):
            return learner.learners
        if isinstance(learner, Search):
            return {f"t{i}": Learner(learner.algorithm, p) for i, p in enumerate(learner.drawn)}
        return None

    def _rest(self, held: Held) -> list[int]:
        rest = [k for k in self.folds if k not in held]
        if not rest:
            raise ValueError("no fold is left to learn from: more folds, or fewer levels")
        return rest

    def _make(self, learner: object, held: Held) -> tuple[DataFrame, dict[str, float]]:
        if isinstance(learner, StackLearner):
            return self._stacked(learner, held)
        if isinstance(learner, Blend):
            weights = self.weights(learner, held)
            wide = self.inputs(learner.learners, held, held)
            return wide.select("key", "fold", "y", weighted_sum(list(weights), list(weights.values())).alias("value")), weights
        if isinstance(learner, Search):
            best = self.chosen(learner, held)
            return self.predictions(self._trial(learner, best), held), {"trial": best}
        fitted = self._fit(learner, self._rest(held))
        return self._made(fitted, held), fitted.importances([str(i) for i in range(self.width)])

    def _made(self, fitted: object, held: Held) -> DataFrame:
        own = self.rows.where(F.col("fold").isin(list(held)))
        return fitted.predict(own, "value").select("key", "fold", "y", "value")

    def _from_moments(self, learner: object) -> bool:
        """Ridge fits need no rows, and their predictions are literals: they are not stored."""
        base = learner.learner if isinstance(learner, Subspace) else learner
        plain = isinstance(base, Learner) and base.algorithm == "ridge" and set(base.params) <= {"alpha"}
        return self.errors and plain and self.width <= MAX_WIDTH

    def _fit(self, learner: object, folds: Sequence[int]) -> object:
        if not self._from_moments(learner):
            return learner.fit(self.rows.where(F.col("fold").isin(list(folds))), self.task)
        places = list(learner.places) if isinstance(learner, Subspace) else None
        base = learner if places is None else learner.learner
        fit = self.moments().of_places(places).ridge(folds, base.params.get("alpha", RIDGE_ALPHA))
        return fit if places is None else FittedSubspace(fit, places)

    def moments(self) -> FoldMoments:
        if self._moments is None:
            self._moments = fold_moments(self.rows)
        return self._moments

    # What learns from predictions

    def _stacked(self, learner: StackLearner, held: Held) -> tuple[DataFrame, dict[str, float]]:
        passed = self._passed(learner, held)
        train = cut_lineage(self._second(learner, self._rest(held), held, passed))
        own = self._second(learner, held, held, passed)
        names = []
        for n, meta in learner.meta.items():
            own = meta.fit(train.select("key", "y", "features"), self.task).predict(own, f"__meta_{n}")
            names.append(f"__meta_{n}")
        return own.select("key", "fold", "y", row_mean(names).alias("value")), {f"passed_{i}": i for i in passed}

    def _second(self, learner: StackLearner, folds: Sequence[int], held: Held, passed: Sequence[int]) -> DataFrame:
        names = [f"__base_{n}" for n in learner.learners]
        wide = self.inputs(learner.learners, folds, held, "__base_")
        if passed:
            some = _sliced(self.rows.select("key", "features"), passed).withColumnRenamed("features", "__passed")
            wide, names = wide.join(some, "key"), [*names, "__passed"]
        made = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
        return made.select("key", "fold", "y", "features")

    def _passed(self, learner: StackLearner, held: Held) -> list[int]:
        if not learner.top_features:
            return []
        found: dict[int, list[float]] = {}
        for x in learner.learners.values():
            base = self._members(x) is None
            facts = {} if not base else self.facts(x, held) if held else self.final(x).importances([str(i) for i in range(self.width)])
            for place, v in facts.items():
                found.setdefault(int(place), []).append(v)
        mean = {i: sum(v) / len(v) for i, v in found.items()}
        return sorted(mean, key=lambda i: (-mean[i], i))[: learner.top_features]

    def member_scores(self, learner: object, held: Held) -> dict[str, float | None]:
        """Mean fold score of each member over the folds that are not held."""
        members = self._members(learner)
        if isinstance(learner, Search) and self._by_moments(learner):
            return self._ridge_scores(learner, held)
        wide = self.inputs(members, self._rest(held), held)
        scores = fold_scores(cut_lineage(wide), "y", list(members), "fold", self.task)
        found = {r["model"]: r["s"] for r in scores.groupBy("model").agg(F.avg("score").alias("s")).collect()}
        return {n: found.get(n) for n in members}

    def weights(self, learner: Blend, held: Held) -> dict[str, float]:
        """The blend's weights, found on the folds that are not held; they sum to 1."""
        members = learner.learners
        if learner.kind not in BLENDS:
            raise ValueError(f"unknown blend {learner.kind}")
        if learner.kind == "vote":
            return {n: 1.0 / len(members) for n in members}
        if learner.kind == "search":
            search = best_weights_mse if self.errors else best_weights_auc
            wide = cut_lineage(self.inputs(members, self._rest(held), held))
            return dict(zip(members, search(wide, "y", list(members)).first()["weights"], strict=True))
        scores = {n: s for n, s in self.member_scores(learner, held).items() if s is not None}
        if not scores:
            return {n: 1.0 / len(members) for n in members}
        best = sorted(scores, key=lambda n: (-scores[n], n))
        if learner.kind == "top":
            best = best[:TOP]
        if learner.kind == "good":
            values = sorted(scores.values())
            middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            best = [n for n in best if scores[n] >= middle]
        sizes = {n: -scores[n] if self.errors else scores[n] for n in best}
        found = score_weights(sizes, self.errors)
        return {n: found.get(n, 0.0) for n in members}

    def chosen(self, learner: Search, held: Held) -> int:
        """The place of the best drawn parameter set, judged on the folds that are not held."""
        if len(self._rest(held)) < 2:
            raise ValueError("a search needs two folds beside the held ones: more folds, or fewer levels")
        scores = self.member_scores(learner, held)
        known = {i: scores[f"t{i}"] for i in range(len(learner.drawn)) if scores[f"t{i}"] is not None}
        if not known:
            raise ValueError("no parameter set has a score")
        return max(known, key=lambda i: (known[i], -i))

    def _trial(self, learner: Search, place: int) -> Learner:
        return Learner(learner.algorithm, learner.drawn[place])

    def _by_moments(self, learner: Search) -> bool:
        only = all(set(p) <= {"alpha"} for p in learner.drawn)
        return self.errors and learner.algorithm == "ridge" and only and self.width <= MAX_WIDTH

    def _ridge_scores(self, learner: Search, held: Held) -> dict[str, float | None]:
        """Every penalty on every fold from the sums alone."""
        rest, moments = self._rest(held), self.moments()
        out: dict[str, float | None] = {}
        for i, p in enumerate(learner.drawn):
            errors = []
            for k in rest:
                fit = moments.ridge([j for j in rest if j != k], p.get("alpha", RIDGE_ALPHA))
                errors.append(moments.squared_error(k, fit))
            known = [e for e in errors if e is not None]
            out[f"t{i}"] = -sum(known) / len(known) if known else None
        return out

    # Fits on all rows

    def final(self, learner: object) -> object:
        """The learner fitted on all rows; what it learns from predictions comes from the held-out ones."""
        name = self.identity(learner)[0]
        if name not in self._final:
            self._final[name] = self._all_rows(learner)
        return self._final[name]

    def _all_rows(self, learner: object) -> object:
        if isinstance(learner, StackLearner):
            passed = self._passed(learner, ())
            train = cut_lineage(self._second(learner, self.folds, (), passed))
            base = {n: self.final(x) for n, x in learner.learners.items()}
            meta = {n: m.fit(train.select("key", "y", "features"), self.task) for n, m in learner.meta.items()}
            return FittedStack(base, meta, passed)
        if isinstance(learner, Blend):
            weights = self.weights(learner, ())
            return FittedVote({n: self.final(x) for n, x in learner.learners.items() if weights[n]}, {n: w for n, w in weights.items() if w})
        if isinstance(learner, Search):
            return self.final(self._trial(learner, self.chosen(learner, ())))
        return self._fit(learner, self.folds)
