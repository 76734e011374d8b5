"""Ensembles over a prediction table: weights are fitted small, applied as literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from math import ceil
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import per_column
from ..functions.scalar import log_likelihood, row_mean, weighted_sum
from ..session import shuffles_freed
from .weight_auc import RANGE_ROWS, class_counts, exact_auc, score_ranges

MIN_BLEND = 2
MIN_TOP = 3
TOP = 5
RANDOM_TRIALS = 200
SCORE_BINS = 1024
# So many rivals share a pass of finer bins, at least, while there are as many.
FEW = 4
# More bins than a rival's distance asks for, as its place within its bounds is an estimate.
SPARE = 1.25
# Bins that did not tell so often will not tell: ties are in doubt however fine the bins.
MOST_RECOUNTS = 2
# Of an AUC, for the sums of doubles behind it.
TOLERANCE = 1e-12
# Candidates ranked together, and scores that any pass may deal.
TOGETHER = 16
AT_ONCE = TOGETHER * RANGE_ROWS


def good_models(scores: DataFrame) -> DataFrame:
    """``(model, score)`` at or above the median score; the input has one row per model."""
    # One row per model: the whole table is one small window.
    middle = F.percentile("score", 0.5).over(Window.partitionBy(F.lit(1)))
    marked = scores.select("model", "score", middle.alias("middle"))
    return marked.where(F.col("score") >= F.col("middle")).select("model", "score")


def vote(df: DataFrame, predictions: Sequence[str], name: str = "ensemble") -> DataFrame:
    return df.withColumn(name, row_mean(predictions))


def weighted(df: DataFrame, weights: Mapping[str, float], name: str = "ensemble") -> DataFrame:
    """The weighted sum of prediction columns; weights are scaled to sum to 1."""
    total = sum(weights.values())
    return df.withColumn(name, weighted_sum(list(weights), [w / total for w in weights.values()]))


def score_weights(scores: Mapping[str, float], errors: bool = False) -> dict[str, float]:
    """Weights proportional to the score, or to 1/error where ``errors`` are given.

    Models without error share all the weight; so do all models if every score is 0.
    """
    if errors and (perfect := [m for m, s in scores.items() if s == 0]):
        return {m: 1.0 / len(perfect) if m in perfect else 0.0 for m in scores}
    return _shares({m: (1.0 / s if errors else s) for m, s in scores.items()})


def _shares(raw: Mapping[str, float]) -> dict[str, float]:
    """Parts of 1 in proportion, or equal parts where all are 0."""
    total = sum(raw.values())
    return {m: w / total if total else 1.0 / len(raw) for m, w in raw.items()}


def blend(df: DataFrame, scores: Mapping[str, float], errors: bool = False) -> DataFrame:
    """Score-weighted blend of all models, at least two."""
    if len(scores) < MIN_BLEND:
        raise ValueError("a blend needs at least two models")
    return weighted(df, score_weights(scores, errors))


def top_blend(df: DataFrame, scores: Mapping[str, float], errors: bool = False) -> DataFrame:
    """Score-weighted blend of the five best of at least three models."""
    if len(scores) < MIN_TOP:
        raise ValueError("a top blend needs at least three models")
    ordered = sorted(scores.items(), key=lambda kv: (kv[1] if errors else -kv[1], kv[0]))
    return weighted(df, score_weights(dict(ordered[:TOP]), errors))


def importance_weights(importances: DataFrame, models: Sequence[str]) -> dict[str, float]:
    """Population variance of each model's importances; 1 for models without any."""
    found = {
        r["model"]: r["w"]
        for r in importances.groupBy("model").agg(F.var_pop("importance").alias("w")).collect()
    }
    return _shares({m: 1.0 if found.get(m) is None else found[m] for m in models})


def posterior_weights(
    df: DataFrame, y: str, predictions: Sequence[str], kind: str = "classification"
) -> DataFrame:
    """``(model, weight)`` proportional to exp(mean log-likelihood) or exp(-MSE).

    The largest value is taken off before exponentiating, which changes no weight.
    """

    def make(p: str) -> dict[str, Column]:
        if kind == "classification":
            return {"fit": F.avg(log_likelihood(y, p))}
        err = F.col(y).cast("double") - F.col(p)
        return {"fit": -F.avg(err * err)}

    fits = per_column(df, predictions, make)
    # One row per model: the whole table is one small window.
    models = Window.partitionBy(F.lit(1))
    raised = fits.withColumn("raw", F.exp(F.col("fit") - F.max("fit").over(models)))
    return raised.select(
        F.col("column").alias("model"), (F.col("raw") / F.sum("raw").over(models)).alias("weight")
    )


def posterior_average(
    df: DataFrame, y: str, predictions: Sequence[str], kind: str = "classification", apply_to: DataFrame | None = None
) -> DataFrame:
    found = {r["model"]: r["weight"] for r in posterior_weights(df, y, predictions, kind).collect()}
    return weighted(df if apply_to is None else apply_to, {p: found[p] for p in predictions})


def simplex_grid(models: int, steps: int) -> list[list[float]]:
    """All weight vectors with components i/steps that sum to 1."""
    heads = product(range(steps + 1), repeat=models - 1)
    return [[i / steps for i in (*h, steps - sum(h))] for h in heads if sum(h) <= steps]


def random_weights(models: int, trials: int = RANDOM_TRIALS, seed: int = 42) -> list[list[float]]:
    """Random weight vectors that sum to 1."""
    draw = Random(seed)
    raw = [[draw.random() for _ in range(models)] for _ in range(trials)]
    return [[v / sum(r) for v in r] for r in raw]


def search_weights_mse(
    df: DataFrame, y: str, predictions: Sequence[str], candidates: Sequence[Sequence[float]]
) -> DataFrame:
    """``(candidate, weights, mse)`` for any number of weight vectors from one pass.

    The error is quadratic in the weights, so the mean products of predictions and
    target are all that is read from the rows.
    """
    xs = [F.col(p).cast("double") for p in predictions]
    t = F.col(y).cast("double")
    # Residuals keep the products small: weights sum to 1, so w.p - y = w.(p - y).
    rest = [x - t for x in xs]
    n = len(xs)
    gram = df.agg(
        *[F.avg(rest[i] * rest[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    ).first()
    rows = []
    for k, given in enumerate(candidates):
        w = [v / sum(given) for v in given]
        mse = sum(
            (1 if i == j else 2) * w[i] * w[j] * gram[f"g{i}_{j}"] for i in range(n) for j in range(i, n)
        )
        rows.append((k, [float(v) for v in given], float(mse)))
    return df.sparkSession.createDataFrame(rows, "candidate int, weights array<double>, mse double")


def search_weights_auc(
    df: DataFrame,
    y: str,
    predictions: Sequence[str],
    candidates: Sequence[Sequence[float]],
    per_pass: int = 16,
) -> DataFrame:
    """``(candidate, weights, auc)``: every candidate is scored on every row.

    Each pass deals the scores of a few candidates, which bounds what one shuffle holds.
    """
    rows = df.count()
    numbered = [(k, [float(v) for v in w]) for k, w in enumerate(candidates)]
    out = None
    for at in range(0, len(numbered), per_pass):
        part = exact_auc(df, y, predictions, numbered[at : at + per_pass], rows)
        out = part if out is None else out.unionByName(part)
    table = df.sparkSession.createDataFrame(numbered, "candidate int, weights array<double>")
    # One row per candidate on both sides.
    return out.join(F.broadcast(table), "candidate").select("candidate", "weights", "auc")


def best_weights_mse(
    df: DataFrame, y: str, predictions: Sequence[str], candidates: Sequence[Sequence[float]] | None = None
) -> DataFrame:
    """One row ``(candidate, weights, mse)``: the least error (ties to the first), 200 random draws by default."""
    tried = random_weights(len(predictions)) if candidates is None else candidates
    return search_weights_mse(df, y, predictions, tried).orderBy("mse", "candidate").limit(1)


def best_weights_auc(
    df: DataFrame,
    y: str,
    predictions: Sequence[str],
    candidates: Sequence[Sequence[float]] | None = None,
    bins: int = SCORE_BINS,
) -> DataFrame:
    """One row ``(candidate, weights, auc)``: the largest AUC (ties to the first), 200 random draws by default.

    One pass counts the classes per score bin of every candidate. Rows of one bin may be
    ranked either way, so the counts bound each AUC from both sides. The most promising
    candidate is ranked exactly; a rival whose bounds reach its AUC is counted again, by as
    many bins as its distance asks for, and ranked exactly where bins cannot tell. A pass deals
    no more scores than the rows hold predictions (or ``AT_ONCE``), and its files go when it ends.
    """
    tried = random_weights(len(predictions)) if candidates is None else list(candidates)
    weights = {k: [float(v) for v in w] for k, w in enumerate(tried)}
    finite = [F.when(F.abs(x) < F.lit(float("inf")), x) for x in (F.col(p).cast("double") for p in predictions)]
    spread = [f(x).alias(f"{n}{i}") for i, x in enumerate(finite) for n, f in (("lo", F.min), ("hi", F.max))]
    with shuffles_freed(df.sparkSession):
        ends = df.agg(F.count(F.lit(1)).alias("rows"), *spread).first().asDict()
    low, high = (
        of([v for n, v in ends.items() if n.startswith(name) and v is not None], default=other)
        for of, name, other in ((min, "lo", 0.0), (max, "hi", 1.0))
    )

    def counted(cut: Mapping[int, int]) -> dict[int, tuple[float, float]]:
        """The least and the largest AUC that each candidate may have, where there is one."""
        found = class_counts(df, y, predictions, [(k, weights[k]) for k in cut], low, high, cut).collect()  # one row per candidate
        pairs = {r["candidate"]: float(r["pos"]) * r["neg"] for r in found}
        return {k: (r["least"] / pairs[k], r["most"] / pairs[k]) for r in found if pairs[k := r["candidate"]]}

    def bins_to_tell(k: int) -> float:
        """Bins by which a rival's bounds should no longer reach the best AUC: doubt falls as bins rise."""
        gap = auc - sum(bounds[k]) / 2
        if gap <= 0 or counts[k] > MOST_RECOUNTS:
            return float("inf")
        return max(2 * cut[k], ceil(SPARE * cut[k] * (bounds[k][1] - bounds[k][0]) / 2 / gap))

    def rival(k: int) -> bool:
        """Whether a candidate may be better than the best, or as good and before it."""
        at_most = bounds[k][1]
        return at_most >= auc - TOLERANCE and (at_most > auc or k < best)

    # What a task holds stays within four times the first pass.
    most, dealt = 4 * bins * len(tried), max(AT_ONCE, len(predictions) * ends["rows"])
    with shuffles_freed(df.sparkSession):
        cut, counts = dict.fromkeys(weights, bins), dict.fromkeys(weights, 1)
        bounds = counted(cut)
        # Until one is ranked, the AUC that some candidate has for sure.
        best, auc = None, max((least for least, _ in bounds.values()), default=0.0)
        left = {k for k, (_, at_most) in bounds.items() if at_most >= auc - TOLERANCE}
        while left:
            finer: dict[int, int] = {}
            if best is not None:
                # A rival that would take the pass from many others is ranked.
                each = most // min(FEW, len(left))
                for need, k in sorted((bins_to_tell(k), k) for k in left):
                    if need > each or sum(finer.values()) + need > most:
                        break
                    finer[k] = int(need)
            if finer:
                cut |= finer
                bounds |= counted(finer)
                counts |= {k: counts[k] + 1 for k in finer}
                left = {k for k in left if rival(k)}
                continue
            now = sorted(left, key=lambda k: (-sum(bounds[k]), k))[: 1 if best is None else TOGETHER]
            edges, sizes = score_ranges(df, y, predictions, [(k, weights[k]) for k in now], ends["rows"])
            while now:
                some = [k for i, k in enumerate(now) if not i or sum(sizes[j] for j in now[: i + 1]) <= dealt]
                ranked = exact_auc(df, y, predictions, [(k, weights[k]) for k in some], ends["rows"], edges=edges).collect()  # one row per candidate
                known = [(-r["auc"], r["candidate"]) for r in ranked]
                less, best = min(known if best is None else [(-auc, best), *known])
                auc = -less
                left = {k for k in left if k not in some and rival(k)}
                now = [k for k in now if k in left]
    if best is None:
        # No AUC at all, or no rows: the first stands for all.
        return search_weights_auc(df, y, predictions, tried[:1])
    return df.sparkSession.createDataFrame([(best, weights[best], auc)], "candidate int, weights array<double>, auc double")


def best_ensemble(scores: DataFrame, best_single: float) -> DataFrame:
    """One row: the best ensemble and whether it beats the best single model."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "model"))
    return scores.agg(best.alias("b")).select(
        F.col("b.model").alias("ensemble"),
        (-F.col("b.s")).alias("score"),
        (-F.col("b.s") > F.lit(best_single)).alias("promoted"),
    )
