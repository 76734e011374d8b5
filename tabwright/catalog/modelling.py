"""Model, search, stacking, flow and stream queries.

Tree sizes are small here: the queries show the operators, the defaults of the
library are those of a full training run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, reduce, search, stacking
from ..operators.encode import fit_count_encoding
from ..operators.impute import fit_imputation
from ..operators.models import CLASSIFICATION, REGRESSION, Learner
from ..plans.feature_flow import FeatureFlow, FittedFlow, KeepColumns
from ..plans.flow_store import FlowStore
from ..plans.hooks import StageHooks
from ..plans.training import train_models
from ..session import new_shared_path
from ..streaming.apply import transform_stream
from .base import GAPS_SQL, labelled_documents, orders_with_gaps, query, read, rounded

_TREES = {"numTrees": 10, "maxDepth": 4}
_ROUNDS = {"maxIter": 5, "maxDepth": 3}
_CLASSIFIERS = {
    "logistic": Learner("logistic"),
    "forest": Learner("forest", _TREES),
    "boosted": Learner("boosted", _ROUNDS),
}
_REGRESSORS = {
    "ridge": Learner("ridge"),
    "lasso": Learner("lasso"),
    "forest": Learner("forest", _TREES),
    "boosted": Learner("boosted", _ROUNDS),
}
_FOLDS = models.FOLDS

_DOC_FEATURES = ["n_chars", "log_chars", "is_en", "is_de", "is_fr"]


def _doc_columns(docs):
    return docs.withColumns(
        {
            "log_chars": F.log1p(F.col("n_chars").cast("double")),
            "is_en": (F.col("lang") == "en").cast("int"),
            "is_de": (F.col("lang") == "de").cast("int"),
            "is_fr": (F.col("lang") == "fr").cast("int"),
        }
    )


def _documents(spark, sf_dir):
    docs = _doc_columns(labelled_documents(spark, sf_dir))
    return models.with_folds(models.feature_table(docs, "doc_id", _DOC_FEATURES, "quality"), _FOLDS)


def _unlabelled(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rest = docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return models.feature_table(_doc_columns(rest), "doc_id", _DOC_FEATURES)


_LINE_FEATURES = ["p_size", "p_retailprice", "p_partkey"]


def _parts(spark, sf_dir):
    """Parts with the average price of their order lines as the target."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    target = lines.agg(F.avg("l_extendedprice").alias("price"))
    parts = read(spark, sf_dir, "part").join(target, "p_partkey")
    return models.with_folds(models.feature_table(parts, "p_partkey", _LINE_FEATURES, "price"), _FOLDS)


# ---- reductions ------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ml_kmeans")
def ml_kmeans(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_MEASURES)
    return reduce.fit_clusters(lines, _MEASURES).transform(lines)


@query("ml_pca")
def ml_pca(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_MEASURES)
    return reduce.fit_components(lines, _MEASURES).transform(lines)


@query(
    "ml_pca_two",
    """WITH m AS (SELECT AVG(o_totalprice / 1000) AS mx, AVG(o_custkey::DOUBLE) AS my, VAR_SAMP(o_totalprice / 1000) AS vx,
    VAR_SAMP(o_custkey::DOUBLE) AS vy, COVAR_SAMP(o_totalprice / 1000, o_custkey::DOUBLE) AS c FROM orders),
  a AS (SELECT *, 0.5::DOUBLE * ATAN2(2 * c, vx - vy) AS t FROM m),
  d AS (SELECT *, CASE WHEN GREATEST(COS(t), SIN(t)) >= -LEAST(COS(t), SIN(t)) THEN 1 ELSE -1 END AS s FROM a)
SELECT o_orderkey, ROUND(s * ((o_totalprice / 1000 - mx) * COS(t) + (o_custkey - my) * SIN(t)), 4) + 0.0 AS pca_0 FROM orders, d""",
)
def ml_pca_two(spark, sf_dir):
    """Two columns: the first axis has a closed form."""
    table = read(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.col("o_custkey").alias("customer")
    )
    made = reduce.fit_components(table, ["price", "customer"], k=1).transform(table)
    return made.select("o_orderkey", (F.round("pca_0", 4) + 0.0).alias("pca_0"))


# ---- single models ---------------------------------------------------------


@query(
    "ml_ridge_closed_form",
    """WITH m AS (SELECT COUNT(*) AS n, AVG(l_quantity) AS m1, AVG(l_tax) AS m2, AVG(l_extendedprice) AS my,
    VAR_POP(l_quantity) * COUNT(*) + 1 AS a, VAR_POP(l_tax) * COUNT(*) + 1 AS d, COVAR_POP(l_quantity, l_tax) * COUNT(*) AS b,
    COVAR_POP(l_quantity, l_extendedprice) * COUNT(*) AS p, COVAR_POP(l_tax, l_extendedprice) * COUNT(*) AS q FROM lineitem),
  w AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM m)
SELECT l_orderkey, l_linenumber, ROUND(my + w1 * (l_quantity - m1) + w2 * (l_tax - m2), 2) AS prediction FROM lineitem, w""",
)
def ml_ridge_closed_form(spark, sf_dir):
    """Two features: the penalised normal equations have a closed form."""
    lines = read(spark, sf_dir, "lineitem")
    # The key is not unique here, so the line number is carried along.
    table = models.feature_table(lines, "l_orderkey", ["l_quantity", "l_tax"], "l_extendedprice", ["l_linenumber"])
    made = Learner("ridge").fit(table, REGRESSION).predict(table, "prediction")
    return rounded(made.select(F.col("key").alias("l_orderkey"), "l_linenumber", "prediction"), 2)


@query(
    "ml_lasso_closed_form",
    """WITH m AS (SELECT AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my, VAR_POP(l_quantity) AS v,
    COVAR_POP(l_quantity, l_extendedprice) AS c FROM lineitem),
  w AS (SELECT *, SIGN(c) * GREATEST(ABS(c) - 1000, 0) / v AS w FROM m)
SELECT l_orderkey, l_linenumber, ROUND(my + w * (l_quantity - mx), 1) AS prediction FROM lineitem, w""",
)
def ml_lasso_closed_form(spark, sf_dir):
    """One feature: the penalty shrinks the covariance."""
    lines = read(spark, sf_dir, "lineitem")
    table = models.feature_table(lines, "l_orderkey", ["l_quantity"], "l_extendedprice", ["l_linenumber"])
    learner = Learner("lasso", {"alpha": 1000.0, "tol": 1e-12, "maxIter": 500})
    made = learner.fit(table, REGRESSION).predict(table, "prediction")
    return rounded(made.select(F.col("key").alias("l_orderkey"), "l_linenumber", "prediction"), 1)


def _scored(table, learners, task):
    return rounded(models.cross_validate(table, learners, task, _FOLDS))


@query("ml_logistic")
def ml_logistic(spark, sf_dir):
    return _scored(_documents(spark, sf_dir), {"logistic": _CLASSIFIERS["logistic"]}, CLASSIFICATION)


@query("ml_forest")
def ml_forest(spark, sf_dir):
    return _scored(_documents(spark, sf_dir), {"forest": _CLASSIFIERS["forest"]}, CLASSIFICATION)


@query("ml_boosted")
def ml_boosted(spark, sf_dir):
    return _scored(_documents(spark, sf_dir), {"boosted": _CLASSIFIERS["boosted"]}, CLASSIFICATION)


@query("ml_cv_regression")
def ml_cv_regression(spark, sf_dir):
    return _scored(_parts(spark, sf_dir), _REGRESSORS, REGRESSION)


@query("ml_variants")
def ml_variants(spark, sf_dir):
    shallow = [{"maxIter": 3 + i, "maxDepth": 2 + i, "stepSize": 0.3 / (i + 1)} for i in range(3)]
    learners = models.boosted_variants("boosted", shallow)
    return _scored(_documents(spark, sf_dir), learners, CLASSIFICATION)


@query("ml_oof")
def ml_oof(spark, sf_dir):
    held = models.oof_predictions(_documents(spark, sf_dir), _CLASSIFIERS, CLASSIFICATION, _FOLDS)
    return held.drop("features")


@query("ml_predict")
def ml_predict(spark, sf_dir):
    """Fitted on labelled documents, applied to all others."""
    train = _documents(spark, sf_dir).drop("fold")
    fitted = models.fit_all(train, _CLASSIFIERS, CLASSIFICATION)
    return models.predict_all(_unlabelled(spark, sf_dir), fitted).drop("features")


@query("ml_importance")
def ml_importance(spark, sf_dir):
    train = _parts(spark, sf_dir).drop("fold")
    fitted = models.fit_all(train, {n: _REGRESSORS[n] for n in ("forest", "boosted")}, REGRESSION)
    return models.importance_table(train, fitted, _LINE_FEATURES)


# ---- search ----------------------------------------------------------------


@query("ml_search")
def ml_search(spark, sf_dir):
    space = {"maxIter": search.Span(2, 5, whole=True), "stepSize": search.Span(0.01, 0.3, log=True), "maxDepth": [2, 3]}
    return search.search(_documents(spark, sf_dir), "boosted", CLASSIFICATION, space, trials=3, folds=_FOLDS).trials


@query("ml_search_ridge")
def ml_search_ridge(spark, sf_dir):
    return search.search(_parts(spark, sf_dir), "ridge", REGRESSION, folds=_FOLDS).trials


@query("ml_early_stop")
def ml_early_stop(spark, sf_dir):
    table = _documents(spark, sf_dir)
    fitted = search.fit_early_stopping(table, CLASSIFICATION, params={"maxIter": 20, "maxDepth": 3})
    return fitted.predict(table, "prediction").drop("features")


# ---- stacking --------------------------------------------------------------


def _stacked(train, table, learner, task=CLASSIFICATION):
    """Fitted on all rows with a target, applied to all rows of ``table``."""
    return learner.fit(train.drop("fold"), task).predict(table, "prediction").drop("features")


@query("ml_stack")
def ml_stack(spark, sf_dir):
    learner = stacking.stack(_CLASSIFIERS, CLASSIFICATION, folds=_FOLDS)
    return _stacked(_documents(spark, sf_dir), _unlabelled(spark, sf_dir), learner)


@query("ml_stack_regression")
def ml_stack_regression(spark, sf_dir):
    learners = {n: _REGRESSORS[n] for n in ("ridge", "forest")}
    parts = _parts(spark, sf_dir)
    return _stacked(parts, parts.drop("fold", "y"), stacking.stack(learners, REGRESSION, folds=_FOLDS), REGRESSION)


@query("ml_two_level")
def ml_two_level(spark, sf_dir):
    learners = {n: _CLASSIFIERS[n] for n in ("logistic", "forest")}
    learner = stacking.two_level_stack(learners, _ROUNDS, folds=_FOLDS)
    return _stacked(_documents(spark, sf_dir), _unlabelled(spark, sf_dir), learner)


@query("ml_feature_stack")
def ml_feature_stack(spark, sf_dir):
    learners = {n: _CLASSIFIERS[n] for n in ("logistic", "forest")}
    train, held = stacking.holdout(_documents(spark, sf_dir).drop("fold"))
    learner = stacking.feature_stack(learners, CLASSIFICATION, _ROUNDS, folds=_FOLDS)
    return _stacked(train, held, learner)


@query("ml_vote")
def ml_vote(spark, sf_dir):
    return _stacked(_documents(spark, sf_dir), _unlabelled(spark, sf_dir), stacking.forest_boosted_vote(trees=10))


# ---- flows -----------------------------------------------------------------


def _train_orders(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir).drop("o_custkey")
    target = (F.col("o_orderstatus") == "F").cast("int").alias("target")
    return table.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", target)


@query("flow_features")
def flow_features(spark, sf_dir):
    return FeatureFlow("o_orderkey", "target").fit_transform(_train_orders(spark, sf_dir))[1]


@query("flow_advanced")
def flow_advanced(spark, sf_dir):
    flow = FeatureFlow("key", "target", advanced=True, target_means=["l_shipmode_like"], select=False)
    lines = read(spark, sf_dir, "lineitem")
    table = lines.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_like"),
        (F.col("l_tax") > 0.04).cast("int").alias("target"),
    )
    return flow.fit_transform(table)[1]


@query("flow_apply")
def flow_apply(spark, sf_dir):
    """Fitted on one table, applied to another that has no target."""
    train = _train_orders(spark, sf_dir)
    fitted = FeatureFlow("o_orderkey", "target", select=False).fit(train)
    return fitted.transform(train.drop("target"))


@query(
    "flow_stream",
    f"""SELECT o_orderkey, ROUND(COALESCE(o_totalprice, (SELECT MEDIAN(o_totalprice) FROM {GAPS_SQL})), 4) AS o_totalprice,
    COALESCE(n, 0) AS o_orderpriority_count FROM orders
  LEFT JOIN (SELECT o_orderpriority AS v, COUNT(*) AS n FROM {GAPS_SQL} GROUP BY 1) m ON o_orderpriority = m.v""",
)
def flow_stream(spark, sf_dir):
    """Steps fitted on a batch, saved, loaded and applied to the same table read as a stream."""
    batch = orders_with_gaps(spark, sf_dir)
    columns = ["o_totalprice", "o_orderpriority_count"]
    steps = [
        fit_imputation(batch, ["o_totalprice"]),
        fit_count_encoding(batch, ["o_orderpriority"]),
        KeepColumns(columns, ["o_orderkey"]),
    ]
    store = FlowStore(spark, new_shared_path(spark, "flows"))
    flow = store.load(store.save(FittedFlow(steps, columns)))
    orders = read(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    out, marks = new_shared_path(spark, "stream"), new_shared_path(spark, "stream-marks")
    wanted = stream.select("o_orderkey", "o_totalprice", "o_orderpriority")
    transform_stream(flow, wanted, out, marks).awaitTermination()
    return rounded(spark.read.parquet(out), 4)


@query(
    "flow_hooks",
    "SELECT o_orderkey, o_totalprice * 2 + 1 AS o_totalprice FROM orders",
)
def flow_hooks(spark, sf_dir):
    hooks = StageHooks()
    hooks.register("features", lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") + 1), priority=1)
    hooks.register("features", lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") * 2), priority=5)
    return hooks.apply("features", read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@query("flow_training")
def flow_training(spark, sf_dir):
    table = _documents(spark, sf_dir)
    test = table.drop("y", "fold")
    return train_models(table, CLASSIFICATION, _CLASSIFIERS, test, _FOLDS).predictions


@query("flow_training_scores")
def flow_training_scores(spark, sf_dir):
    return rounded(train_models(_parts(spark, sf_dir), REGRESSION, _REGRESSORS, None, _FOLDS).board)
