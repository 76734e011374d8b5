"""Fold, metric, ensemble, trial and output queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions.moments import correlation
from ..operators import blend, folds, metrics, quality, submission, trials
from .base import (
    MODELS,
    PREDICTIONS_SQL,
    VALUES_SQL,
    predictions,
    query,
    read,
    rounded,
    union_sql,
    value_predictions,
)

# ---- folds -----------------------------------------------------------------


@query("fold_by_key", "SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders")
def fold_by_key(spark, sf_dir):
    return folds.fold_by_key(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


_STRATIFIED_SQL = """SELECT o_orderkey, o_orderstatus,
    CAST((ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders"""


@query("fold_stratified", _STRATIFIED_SQL)
def fold_stratified(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(table, "o_orderstatus", "o_orderkey")


@query("fold_stratified_split", _STRATIFIED_SQL)
def fold_stratified_split(spark, sf_dir):
    """The same folds with every class split over several tasks."""
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(table, "o_orderstatus", "o_orderkey", in_one_task=2000)


@query("fold_shuffled")
def fold_shuffled(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(table, "o_orderstatus", "o_orderkey", shuffle_seed=folds.SEED)


# ---- metrics ---------------------------------------------------------------


def _auc_sql(table: str, p: str, extra: str = "") -> str:
    return f"""SELECT '{p}' AS model{extra}, ROUND(SUM(pos * (below + neg / 2.0::DOUBLE)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM (
    SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT {p} AS s, SUM(y)::DOUBLE AS pos, SUM(1 - y)::DOUBLE AS neg FROM {table} GROUP BY 1))"""


_ALL_AUC_SQL = union_sql(MODELS, lambda p: _auc_sql(PREDICTIONS_SQL, p))


@query("metric_auc", _ALL_AUC_SQL)
def metric_auc(spark, sf_dir):
    return rounded(metrics.auc_scores(predictions(spark, sf_dir), "y", MODELS))


@query("metric_auc_split", _ALL_AUC_SQL)
def metric_auc_split(spark, sf_dir):
    """The same scores with every model's ranking split over several tasks."""
    return rounded(metrics.auc_scores(predictions(spark, sf_dir), "y", MODELS, in_one_task=2000))


@query(
    "metric_class",
    union_sql(
        MODELS,
        lambda p: f"""SELECT '{p}' AS model, ROUND(AVG(CASE WHEN ({p} > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
    ROUND(tp::DOUBLE / NULLIF(tp + fp, 0), 6) AS precision, ROUND(tp::DOUBLE / NULLIF(tp + fn, 0), 6) AS recall,
    ROUND(2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1,
    ROUND(-AVG(CASE WHEN y = 1 THEN LN({p}) ELSE LN(1 - {p}) END), 6) AS logloss
  FROM {PREDICTIONS_SQL}, (SELECT COUNT(*) FILTER (WHERE {p} > 0.5 AND y = 1) AS tp,
    COUNT(*) FILTER (WHERE {p} > 0.5 AND y = 0) AS fp, COUNT(*) FILTER (WHERE NOT {p} > 0.5 AND y = 1) AS fn
    FROM {PREDICTIONS_SQL}) GROUP BY tp, fp, fn""",
    ),
)
def metric_class(spark, sf_dir):
    return rounded(metrics.class_scores(predictions(spark, sf_dir), "y", MODELS))


_THRESHOLD_SQL = union_sql(
    MODELS,
    lambda p: f"""SELECT '{p}' AS model, t / 100::DOUBLE AS threshold, COUNT(*) FILTER (WHERE {p} > t / 100::DOUBLE AND y = 1) AS tp,
    COUNT(*) FILTER (WHERE {p} > t / 100::DOUBLE AND y = 0) AS fp, COUNT(*) FILTER (WHERE {p} <= t / 100::DOUBLE AND y = 1) AS fn
  FROM {PREDICTIONS_SQL}, (SELECT unnest(range(10, 90)) AS t) GROUP BY t""",
)


@query(
    "metric_thresholds",
    f"""WITH cells AS ({_THRESHOLD_SQL}),
  scored AS (
    SELECT *, tp::DOUBLE / NULLIF(tp + fp, 0) AS precision, tp::DOUBLE / NULLIF(tp + fn, 0) AS recall,
      2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0) AS f1 FROM cells)
  SELECT model, threshold, tp, fp, fn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
    ROW_NUMBER() OVER (PARTITION BY model ORDER BY f1 DESC NULLS LAST, threshold) = 1 AS best FROM scored""",
)
def metric_thresholds(spark, sf_dir):
    """Eighty thresholds of three models from one histogram."""
    return rounded(metrics.threshold_scores(predictions(spark, sf_dir), "y", MODELS))


@query(
    "metric_regression",
    union_sql(
        MODELS,
        lambda p: f"""SELECT '{p}' AS model, ROUND(AVG((y - {p}) * (y - {p})), 2) AS mse, ROUND(AVG(ABS(y - {p})), 4) AS mae,
    ROUND(1 - SUM((y - {p}) * (y - {p})) / (VAR_POP(y) * COUNT(*)), 6) AS r2 FROM {VALUES_SQL}""",
    ),
)
def metric_regression(spark, sf_dir):
    scores = metrics.regression_scores(value_predictions(spark, sf_dir), "y", MODELS)
    return rounded(scores, 6, mse=2, mae=4)


_FOLD_AUC_SQL = "\nUNION ALL\n".join(
    f"SELECT model, {k}::BIGINT AS fold, auc AS score FROM ("
    + _auc_sql(f"(SELECT * FROM {PREDICTIONS_SQL} WHERE fold = {k})", p)
    + ")"
    for p, k in product(MODELS, range(5))
)


@query("metric_fold_auc", _FOLD_AUC_SQL)
def metric_fold_auc(spark, sf_dir):
    return rounded(metrics.fold_scores(predictions(spark, sf_dir), "y", MODELS))


_FOLD_MSE_SQL = union_sql(
    MODELS,
    lambda p: f"SELECT '{p}' AS model, fold, -AVG((y - {p}) * (y - {p})) AS score FROM {VALUES_SQL} GROUP BY fold",
)


@query(
    "model_leaderboard",
    f"""SELECT model, ROUND(AVG(score), 2) AS mean_score, ROUND(STDDEV_POP(score), 2) AS std_score, COUNT(score) AS folds
  FROM ({_FOLD_MSE_SQL}) GROUP BY model ORDER BY 2 DESC, model""",
)
def model_leaderboard(spark, sf_dir):
    scores = metrics.fold_scores(value_predictions(spark, sf_dir), "y", MODELS, kind="regression")
    return rounded(metrics.leaderboard(scores), 2)


@query(
    "model_best",
    f"""SELECT model AS best_model, ROUND(s, 2) AS best_score FROM (SELECT model, AVG(score) AS s
  FROM ({_FOLD_MSE_SQL}) GROUP BY model ORDER BY s DESC, model LIMIT 1)""",
)
def model_best(spark, sf_dir):
    scores = metrics.fold_scores(value_predictions(spark, sf_dir), "y", MODELS, kind="regression")
    return rounded(metrics.best_model(scores), 2)


_FEATURES = ["o_totalprice", "o_custkey", "o_orderkey"]


def _importances(spark, sf_dir):
    """Absolute correlation of each model's predictions with each order column."""
    extra = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = predictions(spark, sf_dir).join(extra, "o_orderkey")
    cells = [
        F.struct(
            F.lit(m).alias("model"),
            F.lit(f).alias("feature"),
            F.abs(correlation(m, f)).alias("importance"),
        ).alias(f"{m}_{f}")
        for m, f in product(MODELS, _FEATURES)
    ]
    names = [f"{m}_{f}" for m, f in product(MODELS, _FEATURES)]
    return joined.agg(*cells).select(F.inline(F.array(*names)))


_IMPORTANCE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, '{f}' AS feature, ABS(CORR(p.{m}, {'o' if f == 'o_totalprice' else 'p'}.{f})) AS importance"
    f" FROM {PREDICTIONS_SQL} p JOIN orders o ON p.o_orderkey = o.o_orderkey"
    for m, f in product(MODELS, _FEATURES)
)


@query(
    "model_importance_top",
    f"SELECT feature, ROUND(AVG(importance), 6) AS importance FROM ({_IMPORTANCE_SQL}) GROUP BY feature ORDER BY AVG(importance) DESC, feature LIMIT 20",
)
def model_importance_top(spark, sf_dir):
    return rounded(metrics.top_importances(_importances(spark, sf_dir)))


# ---- ensembles -------------------------------------------------------------


@query(
    "ens_good_models",
    f"""WITH s AS ({_ALL_AUC_SQL}) SELECT model, auc AS score FROM s WHERE auc >= (SELECT MEDIAN(auc) FROM s)""",
)
def ens_good_models(spark, sf_dir):
    scores = metrics.auc_scores(predictions(spark, sf_dir), "y", MODELS)
    return rounded(blend.good_models(scores.select("model", F.round("auc", 6).alias("score"))))


@query(
    "ens_vote",
    f"SELECT o_orderkey, ROUND((pred_a + pred_b + pred_c) / 3, 6) AS ensemble FROM {PREDICTIONS_SQL}",
)
def ens_vote(spark, sf_dir):
    voted = blend.vote(predictions(spark, sf_dir), MODELS)
    return rounded(voted.select("o_orderkey", "ensemble"))


@query(
    "ens_vote_score",
    f"""SELECT ROUND(AVG(CASE WHEN ((pred_a + pred_b + pred_c) / 3 > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy
  FROM {PREDICTIONS_SQL}""",
)
def ens_vote_score(spark, sf_dir):
    voted = blend.vote(predictions(spark, sf_dir), MODELS)
    return rounded(metrics.class_scores(voted, "y", ["ensemble"]).select("accuracy"))


def _scores(spark, sf_dir) -> dict[str, float]:
    found = metrics.auc_scores(predictions(spark, sf_dir), "y", MODELS).collect()
    return {r["model"]: r["auc"] for r in found}


_WEIGHTS_SQL = "SELECT " + ", ".join(
    f"MAX(CASE WHEN model = '{m}' THEN auc END) AS w_{m[-1]}" for m in MODELS
)


@query(
    "ens_blend",
    f"""WITH s AS ({_ALL_AUC_SQL}), w AS ({_WEIGHTS_SQL} FROM s)
SELECT o_orderkey, ROUND((w_a * pred_a + w_b * pred_b + w_c * pred_c) / (w_a + w_b + w_c), 4) AS ensemble FROM {PREDICTIONS_SQL}, w""",
)
def ens_blend(spark, sf_dir):
    scores = {m: round(s, 6) for m, s in _scores(spark, sf_dir).items()}
    blended = blend.blend(predictions(spark, sf_dir), {m: scores[m] for m in MODELS})
    return rounded(blended.select("o_orderkey", "ensemble"), 4)


@query(
    "ens_top_blend",
    f"""WITH s AS ({_FOLD_MSE_SQL}), m AS (SELECT model, 1 / -AVG(score) AS w FROM s GROUP BY model),
  w AS (SELECT {", ".join(f"MAX(CASE WHEN model = '{m}' THEN w END) AS w_{m[-1]}" for m in MODELS)} FROM m)
SELECT o_orderkey, ROUND((w_a * pred_a + w_b * pred_b + w_c * pred_c) / (w_a + w_b + w_c), 3) AS ensemble FROM {VALUES_SQL}, w""",
)
def ens_top_blend(spark, sf_dir):
    table = value_predictions(spark, sf_dir)
    board = metrics.leaderboard(metrics.fold_scores(table, "y", MODELS, kind="regression")).collect()
    errors = {r["model"]: -r["mean_score"] for r in board}
    blended = blend.top_blend(table, {m: errors[m] for m in MODELS}, errors=True)
    return rounded(blended.select("o_orderkey", "ensemble"), 3)


@query(
    "ens_importance_blend",
    f"""WITH v AS (SELECT model, VAR_POP(importance) AS w FROM ({_IMPORTANCE_SQL}) GROUP BY model),
  w AS (SELECT {", ".join(f"MAX(CASE WHEN model = '{m}' THEN w END) AS w_{m[-1]}" for m in MODELS)} FROM v)
SELECT o_orderkey, ROUND((w_a * pred_a + w_b * pred_b + w_c * pred_c) / (w_a + w_b + w_c), 6) AS ensemble FROM {PREDICTIONS_SQL}, w""",
)
def ens_importance_blend(spark, sf_dir):
    weights = blend.importance_weights(_importances(spark, sf_dir), MODELS)
    blended = blend.weighted(predictions(spark, sf_dir), weights)
    return rounded(blended.select("o_orderkey", "ensemble"))


_POSTERIOR_SQL = f"""WITH l AS ({union_sql(MODELS, lambda p: f"SELECT '{p}' AS model, AVG(CASE WHEN y = 1 THEN LN({p}) ELSE LN(1 - {p}) END) AS l FROM {PREDICTIONS_SQL}")}),
  e AS (SELECT model, EXP(l - MAX(l) OVER ()) AS e FROM l), p AS (SELECT model, e / SUM(e) OVER () AS weight FROM e)"""


@query("ens_posterior_weights", f"{_POSTERIOR_SQL} SELECT model, ROUND(weight, 6) AS weight FROM p")
def ens_posterior_weights(spark, sf_dir):
    return rounded(blend.posterior_weights(predictions(spark, sf_dir), "y", MODELS))


@query(
    "ens_bma",
    f"""{_POSTERIOR_SQL}, w AS (SELECT {", ".join(f"MAX(CASE WHEN model = '{m}' THEN weight END) AS w_{m[-1]}" for m in MODELS)} FROM p)
SELECT o_orderkey, ROUND(w_a * pred_a + w_b * pred_b + w_c * pred_c, 6) AS ensemble FROM {PREDICTIONS_SQL}, w""",
)
def ens_bma(spark, sf_dir):
    averaged = blend.posterior_average(predictions(spark, sf_dir), "y", MODELS)
    return rounded(averaged.select("o_orderkey", "ensemble"))


_GRID = blend.simplex_grid(3, 10)
_GRID_SQL = (
    "(SELECT i + 0 AS i, j + 0 AS j, CAST(ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS INTEGER) AS candidate,"
    " i / 10.0::DOUBLE AS w_a, j / 10.0::DOUBLE AS w_b, (10 - i - j) / 10.0::DOUBLE AS w_c"
    " FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10)"
)


@query(
    "ens_weight_search_mse",
    f"""SELECT candidate, ROUND(AVG((w_a * pred_a + w_b * pred_b + w_c * pred_c - y) ** 2), 0) AS mse
  FROM {VALUES_SQL}, {_GRID_SQL} GROUP BY candidate""",
)
def ens_weight_search_mse(spark, sf_dir):
    found = blend.search_weights_mse(value_predictions(spark, sf_dir), "y", MODELS, _GRID)
    return rounded(found.select("candidate", "mse"), 0)


_COARSE = blend.simplex_grid(3, 4)


@query(
    "ens_weight_search_auc",
    f"""WITH g AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS INTEGER) AS candidate,
    i / 4.0::DOUBLE AS w_a, j / 4.0::DOUBLE AS w_b, (4 - i - j) / 4.0::DOUBLE AS w_c FROM range(5) a(i), range(5) b(j) WHERE i + j <= 4),
  s AS (SELECT candidate, ROUND(w_a * pred_a + w_b * pred_b + w_c * pred_c, 12) AS s, SUM(y)::DOUBLE AS pos, SUM(1 - y)::DOUBLE AS neg
    FROM {PREDICTIONS_SQL}, g GROUP BY 1, 2),
  b AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY candidate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT candidate, ROUND(SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)), 5) AS auc FROM b GROUP BY candidate""",
)
def ens_weight_search_auc(spark, sf_dir):
    found = blend.search_weights_auc(predictions(spark, sf_dir), "y", MODELS, _COARSE)
    return rounded(found.select("candidate", "auc"), 5)


_RANDOM = blend.random_weights(3)
_RANDOM_SQL = (
    "(SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in w)})" for k, w in enumerate(_RANDOM))
    + ") t(candidate, w_a, w_b, w_c))"
)


@query(
    "ens_best_weights_mse",
    f"""SELECT candidate, ROUND(AVG((w_a * pred_a + w_b * pred_b + w_c * pred_c - y) ** 2), 0) AS mse
  FROM {VALUES_SQL}, {_RANDOM_SQL} GROUP BY candidate
  ORDER BY AVG((w_a * pred_a + w_b * pred_b + w_c * pred_c - y) ** 2) LIMIT 1""",
)
def ens_best_weights_mse(spark, sf_dir):
    """The best of 200 random weight vectors."""
    found = blend.best_weights_mse(value_predictions(spark, sf_dir), "y", MODELS)
    return rounded(found.select("candidate", "mse"), 0)


@query(
    "ens_best_weights_auc",
    f"""WITH s AS (SELECT candidate, ROUND(w_a * pred_a + w_b * pred_b + w_c * pred_c, 12) AS s, SUM(y)::DOUBLE AS pos, SUM(1 - y)::DOUBLE AS neg
    FROM {PREDICTIONS_SQL}, {_RANDOM_SQL} GROUP BY 1, 2),
  b AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY candidate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT ROUND(MAX(auc), 5) AS auc FROM (SELECT SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)) AS auc FROM b GROUP BY candidate)""",
)
def ens_best_weights_auc(spark, sf_dir):
    """The best of 200 random weight vectors; only those that can be best are ranked."""
    return rounded(blend.best_weights_auc(predictions(spark, sf_dir), "y", MODELS).select("auc"), 5)


@query(
    "ens_best",
    f"""WITH s AS ({_ALL_AUC_SQL}),
  v AS ({_auc_sql(f"(SELECT y, ROUND((pred_a + pred_b + pred_c) / 3, 12) AS vote FROM {PREDICTIONS_SQL})", "vote")})
SELECT model AS ensemble, auc AS score, auc > (SELECT MAX(auc) FROM s) AS promoted FROM v""",
)
def ens_best(spark, sf_dir):
    table = predictions(spark, sf_dir)
    voted = blend.vote(table, MODELS, "vote")
    single = max(_scores(spark, sf_dir).values())
    scores = metrics.auc_scores(voted, "y", ["vote"]).select("model", F.col("auc").alias("score"))
    return rounded(blend.best_ensemble(scores, single))


# ---- trials ----------------------------------------------------------------


def _trials(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("trial"), F.col("value").alias("score"), "user_id"
    )


_RUNNING_SQL = """SELECT event_id AS trial, value AS score,
    MAX(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM events"""


@query("hpo_running_best", _RUNNING_SQL)
def hpo_running_best(spark, sf_dir):
    return trials.running_best(_trials(spark, sf_dir).drop("user_id"))


@query("hpo_running_best_split", _RUNNING_SQL)
def hpo_running_best_split(spark, sf_dir):
    """The same history cut into ranges."""
    return trials.running_best(_trials(spark, sf_dir).drop("user_id"), in_one_task=1000)


@query(
    "hpo_best_trial",
    """SELECT event_id AS best_trial, value AS best_score, (SELECT COUNT(*) FROM events) AS trials FROM events
  ORDER BY value DESC, event_id LIMIT 1""",
)
def hpo_best_trial(spark, sf_dir):
    return trials.best_trial(_trials(spark, sf_dir))


@query(
    "hpo_param_importance",
    """WITH r AS (SELECT 'user_id' AS param, ABS(CORR(user_id, value)) AS r FROM events
  UNION ALL SELECT 'trial', ABS(CORR(event_id, value)) FROM events)
SELECT param, ROUND(r / SUM(r) OVER (), 6) AS importance FROM r""",
)
def hpo_param_importance(spark, sf_dir):
    return rounded(trials.parameter_importance(_trials(spark, sf_dir), ["user_id", "trial"]))


# ---- output ----------------------------------------------------------------


def _sample(spark, sf_dir, kind: str):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(None).cast(kind).alias("target")
    )


@query("sub_choose", f"SELECT o_orderkey, ROUND((pred_a + pred_b + pred_c) / 3, 6) AS chosen FROM {PREDICTIONS_SQL}")
def sub_choose(spark, sf_dir):
    voted = blend.vote(predictions(spark, sf_dir), MODELS)
    name = submission.choose_prediction([*MODELS, "ensemble"])
    return rounded(voted.select("o_orderkey", F.col(name).alias("chosen")))


@query(
    "sub_threshold",
    f"SELECT o_orderkey AS id, CASE WHEN pred_a > 0.5 THEN 1 ELSE 0 END AS target FROM {PREDICTIONS_SQL}",
)
def sub_threshold(spark, sf_dir):
    table = predictions(spark, sf_dir)
    return submission.shape_output(table, "o_orderkey", "pred_a", _sample(spark, sf_dir, "bigint"))


@query("sub_boolean", f"SELECT o_orderkey AS id, pred_b > 0.3 AS target FROM {PREDICTIONS_SQL}")
def sub_boolean(spark, sf_dir):
    table = predictions(spark, sf_dir)
    sample = _sample(spark, sf_dir, "boolean")
    return submission.shape_output(table, "o_orderkey", "pred_b", sample, threshold=0.3)


@query("sub_words", f"SELECT o_orderkey AS id, pred_c > 0.5 AS target FROM {PREDICTIONS_SQL}")
def sub_words(spark, sf_dir):
    word = F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("False")
    sample = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), word.alias("target"))
    return submission.shape_output(predictions(spark, sf_dir), "o_orderkey", "pred_c", sample)


@query("sub_probability", f"SELECT o_orderkey AS id, pred_a AS target FROM {PREDICTIONS_SQL}")
def sub_probability(spark, sf_dir):
    table = predictions(spark, sf_dir)
    sample = _sample(spark, sf_dir, "double")
    return submission.shape_output(table, "o_orderkey", "pred_a", sample)


_HOLES_SQL = f"""(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN pred_a END AS target FROM {PREDICTIONS_SQL}
    WHERE o_custkey % 50 <> 0)"""


def _holed(spark, sf_dir):
    """An output without some customers' rows and with some values missing."""
    value = F.when(F.col("o_orderkey") % 7 != 0, F.col("pred_a")).alias("target")
    table = predictions(spark, sf_dir).where(F.col("o_custkey") % 50 != 0)
    return table.select(F.col("o_orderkey").alias("id"), value)


@query(
    "sub_fill",
    f"SELECT id, ROUND(COALESCE(target, (SELECT MEDIAN(target) FROM {_HOLES_SQL})), 8) AS target FROM {_HOLES_SQL}",
)
def sub_fill(spark, sf_dir):
    return rounded(submission.fill_output(_holed(spark, sf_dir)), 8)


@query(
    "sub_validate",
    f"""SELECT 'missing_values' AS "check", '0' AS expected, COUNT(*)::VARCHAR AS got FROM {_HOLES_SQL} WHERE target IS NULL
UNION ALL SELECT 'rows', (SELECT COUNT(*) FROM orders)::VARCHAR, COUNT(*)::VARCHAR FROM {_HOLES_SQL}
UNION ALL SELECT 'ids', '0', COUNT(*)::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT id FROM {_HOLES_SQL})""",
)
def sub_validate(spark, sf_dir):
    return submission.validate_output(_holed(spark, sf_dir), _sample(spark, sf_dir, "double"))


@query(
    "sub_key_mismatch",
    """SELECT COUNT(*) FILTER (WHERE c.c_custkey IS NULL) AS only_left, COUNT(*) FILTER (WHERE o.k IS NULL) AS only_right,
    COUNT(*) FILTER (WHERE c.c_custkey IS NOT NULL AND o.k IS NOT NULL) AS both
  FROM (SELECT DISTINCT o_custkey AS k FROM orders) o FULL JOIN customer c ON o.k = c.c_custkey""",
)
def sub_key_mismatch(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return quality.key_mismatch(orders, customers, "k")


@query(
    "sub_stats",
    f"""SELECT ROUND(AVG(pred_a), 6) AS mean, ROUND(STDDEV_SAMP(pred_a), 6) AS std, ROUND(MIN(pred_a), 6) AS min,
    ROUND(MAX(pred_a), 6) AS max FROM {PREDICTIONS_SQL}""",
)
def sub_stats(spark, sf_dir):
    return rounded(submission.prediction_stats(predictions(spark, sf_dir), "pred_a"))


@query(
    "sub_compare",
    union_sql(
        MODELS,
        lambda p: f"""SELECT '{p}' AS source, COUNT(*) AS rows, ROUND(AVG({p}), 6) AS mean, ROUND(STDDEV_SAMP({p}), 6) AS std,
    ROUND(MIN({p}), 6) AS min, ROUND(MAX({p}), 6) AS max, COUNT(DISTINCT {p}) AS n_unique FROM {PREDICTIONS_SQL}""",
    ),
)
def sub_compare(spark, sf_dir):
    table = predictions(spark, sf_dir)
    outputs = {m: table.select("o_orderkey", F.col(m).alias("target")) for m in MODELS}
    return rounded(submission.compare_outputs(outputs, "target"))
