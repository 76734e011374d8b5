"""A training contest without leaks: singles, tuned learners, blends and stacks on the same held-out rows.

Every contestant predicts each fold without having seen it, at any depth: weights, meta models
and parameter sets are learnt from the other folds only (``operators.crossfit``). All are judged
by the mean of one score per fold. The winner is fitted on all rows and can be written to a folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blend import MIN_BLEND, MIN_TOP
from ..operators.crossfit import Blend, CrossFit, Search
from ..operators.metrics import fold_scores
from ..operators.models import default_learners
from ..operators.saved import save_learner
from ..operators.search import SPACES, TRIALS, draw_trials
from ..operators.stacking import StackLearner, feature_stack, linear_meta, two_level_stack
from ..session import cut_lineage

STACKS = ("stack", "two_level", "feature_stack")
SINGLE, TUNED, BLENDED, STACKED = "single", "tuned", "blend", "stack"


def enter(
    task: str,
    learners: Mapping[str, object] | None = None,
    tuned: Sequence[str] = (),
    trials: int = TRIALS,
    stacks: Sequence[str] = ("stack",),
    blends: Sequence[str] = ("vote", "score", "top", "good", "search"),
    spaces: Mapping[str, Mapping[str, object]] = SPACES,
) -> tuple[dict[str, object], dict[str, str]]:
    """The contestants by name, and the kind of each.

    A tuned learner takes the place of the one of its algorithm, also inside blends and stacks.
    Blends need two members (``top`` and ``good`` three), a two-level stack needs two learners.
    """
    if unknown := set(stacks) - set(STACKS):
        raise ValueError(f"unknown stacks {', '.join(sorted(unknown))}")
    given = dict(learners or default_learners(task))
    singles: dict[str, object] = {}
    kinds: dict[str, str] = {}
    for n, x in given.items():
        if n in tuned:
            singles[f"{n}_tuned"] = Search(x.algorithm, tuple(draw_trials(spaces[x.algorithm], trials)))
            kinds[f"{n}_tuned"] = TUNED
        else:
            singles[n], kinds[n] = x, SINGLE
    out = dict(singles)
    for b in blends:
        if len(singles) >= (MIN_TOP if b in ("top", "good") else MIN_BLEND):
            out[f"blend_{b}"], kinds[f"blend_{b}"] = Blend(singles, b), BLENDED
    made = {
        "stack": lambda: StackLearner(singles, {"linear": linear_meta(task)}),
        "two_level": lambda: two_level_stack(singles),
        "feature_stack": lambda: feature_stack(singles, task),
    }
    for s in stacks:
        if len(singles) >= MIN_BLEND:
            out[s], kinds[s] = made[s](), STACKED
    return out, kinds


@dataclass
class Contest:
    """``scores`` per contestant and fold, ``table`` with one row per contestant, and the winner."""

    fit: CrossFit
    contestants: dict[str, object]
    scores: DataFrame
    table: DataFrame
    best: str

    def winner(self) -> object:
        """The best contestant fitted on all rows."""
        return self.fit.final(self.contestants[self.best])

    def predict(self, test: DataFrame) -> DataFrame:
        """``test`` (``key, features``) with the winner's ``prediction`` in place of the features."""
        return self.winner().predict(test, "prediction").drop("features")

    def save(self, path: str) -> None:
        save_learner(self.fit.spark, self.winner(), path)


def run_contest(
    table: DataFrame,
    task: str,
    contestants: Mapping[str, object],
    kinds: Mapping[str, str] | None = None,
    folds: int = 5,
    store: str | None = None,
    parallelism: int = 4,
) -> Contest:
    """Score every contestant on ``table`` (``key, features, y, fold``) and promote the best.

    ``table`` of the result is ``contestant, kind, mean_score, std_score, folds, promoted``: AUC
    or negative squared error, the mean over folds; ties go to the first name. A contestant
    without a score in some fold (one class only) cannot win. With ``store`` the fits of an
    earlier run on the same rows are found again.
    """
    if not contestants:
        raise ValueError("a contest needs contestants")
    fit = CrossFit(table, task, folds, store, parallelism)
    fit.prepare(contestants)
    held = cut_lineage(fit.inputs(contestants, fit.folds, ()))
    scores = cut_lineage(fold_scores(held, "y", list(contestants), "fold", task).withColumnRenamed("model", "contestant"))
    found = scores.groupBy("contestant").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count("score").alias("folds")
    )
    rows = found.collect()  # one row per contestant
    most = max((r["folds"] for r in rows), default=0)
    able = [r for r in rows if r["mean_score"] is not None and r["folds"] == most]
    if not able:
        raise ValueError("no contestant has a score")
    best = min(able, key=lambda r: (-r["mean_score"], r["contestant"]))["contestant"]
    kind = F.create_map(*[F.lit(v) for n in contestants for v in (n, (kinds or {}).get(n, SINGLE))])
    board = found.select(
        "contestant", kind[F.col("contestant")].alias("kind"), "mean_score", "std_score", "folds", (F.col("contestant") == best).alias("promoted")
    )
    return Contest(fit, dict(contestants), scores, board, best)
