"""Experiment-history and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lookup
from ..functions.columns import nan_to_null
from ..operators import experiments as ex
from ..operators import profile
from ..session import new_shared_path
from ..sources import tables
from ..sources.experiment_store import ExperimentStore
from .base import (
    ARTIFACTS_SQL,
    EXPERIMENTS_SQL,
    PREDICTIONS_SQL,
    RUNS_SQL,
    artifacts,
    experiments,
    predictions,
    query,
    read,
    rounded,
    runs,
    union_sql,
)

NOW_SQL = "(SELECT MAX(ts) FROM events)"


@query(
    "exp_list",
    f"""SELECT id, name, competition, created_at, status FROM {EXPERIMENTS_SQL}
  WHERE competition = 'click' AND status = 'completed' ORDER BY created_at DESC, id LIMIT 20""",
)
def exp_list(spark, sf_dir):
    found = ex.list_experiments(experiments(spark, sf_dir), "click", "completed")
    return found.select("id", "name", "competition", "created_at", "status")


def _best_sql(order: str) -> str:
    return f"""SELECT competition, id, value FROM (SELECT competition, id, CAST(json_extract_string(metrics, '$.k') AS DOUBLE) AS value,
    ROW_NUMBER() OVER (PARTITION BY competition ORDER BY CAST(json_extract_string(metrics, '$.k') AS DOUBLE) {order}, created_at DESC, id) AS rn
    FROM {EXPERIMENTS_SQL} WHERE status = 'completed') WHERE rn = 1"""


@query("exp_best", _best_sql("DESC"))
def exp_best(spark, sf_dir):
    return ex.best_experiments(experiments(spark, sf_dir), "k")


@query("exp_best_minimum", _best_sql("ASC"))
def exp_best_minimum(spark, sf_dir):
    return ex.best_experiments(experiments(spark, sf_dir), "k", minimize=True)


@query(
    "exp_compare",
    f"""SELECT id, name, competition, status, created_at, duration_seconds,
    CAST(json_extract_string(metrics, '$.k') AS DOUBLE) AS metric_k FROM {EXPERIMENTS_SQL}""",
)
def exp_compare(spark, sf_dir):
    return ex.compare_experiments(experiments(spark, sf_dir))


@query(
    "exp_metric_values",
    f"""SELECT id, metric, TRY_CAST(json_extract_string(metrics, '$.' || metric) AS DOUBLE) AS value
  FROM (SELECT id, metrics, unnest(json_keys(metrics)) AS metric FROM {EXPERIMENTS_SQL})""",
)
def exp_metric_values(spark, sf_dir):
    return ex.metric_values(experiments(spark, sf_dir))


@query(
    "exp_latest_metrics",
    """SELECT user_id AS experiment_id, event_type AS "key", value FROM events
  QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def exp_latest_metrics(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"),
        F.col("event_type").alias("key"),
        "value",
        F.col("ts").alias("logged_at"),
        F.col("event_id").alias("seq"),
    )
    return ex.latest_metrics(log)


@query(
    "exp_merge_metrics",
    """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k, CAST(user_id AS BIGINT) AS u FROM events""",
)
def exp_merge_metrics(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    news = F.to_json(F.struct((k + 1).alias("k"), F.col("user_id").alias("u")))
    table = read(spark, sf_dir, "events").withColumn("news", news)
    merged = table.select(F.col("event_id").alias("id"), ex.merge_metrics("props", "news").alias("m"))
    return merged.select(
        "id",
        F.get_json_object("m", "$.k").cast("bigint").alias("k"),
        F.get_json_object("m", "$.u").cast("bigint").alias("u"),
    )


# The experiment tables of the reports: customers as experiments.
_HEADS_SQL = "(SELECT DISTINCT user_id AS id, 'user ' || user_id AS name FROM events)"


def _heads(spark, sf_dir):
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return users.withColumn("name", F.concat(F.lit("user "), F.col("id").cast("string")))


@query(
    "exp_run_report",
    f"""SELECT h.id, h.name, r.stage, r.status, COUNT(*) AS runs, MIN(r.started_at) AS first_started
  FROM {_HEADS_SQL} h LEFT JOIN {RUNS_SQL} r ON h.id = r.experiment_id GROUP BY ALL""",
)
def exp_run_report(spark, sf_dir):
    return ex.run_report(_heads(spark, sf_dir), runs(spark, sf_dir))


@query(
    "exp_artifact_report",
    f"""SELECT h.id, a.type, COUNT(*) AS artifacts, ROUND(SUM(a.size_bytes) / 1048576.0::DOUBLE, 6) AS size_mb
  FROM {_HEADS_SQL} h LEFT JOIN {ARTIFACTS_SQL} a ON h.id = a.experiment_id GROUP BY ALL""",
)
def exp_artifact_report(spark, sf_dir):
    return rounded(ex.artifact_report(_heads(spark, sf_dir), artifacts(spark, sf_dir)))


@query(
    "exp_durations",
    """SELECT o_orderkey, CAST(EPOCH(l.ended - o_orderdate) AS DOUBLE) AS duration_seconds FROM orders
  JOIN (SELECT l_orderkey, MAX(l_shipdate) AS ended FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""",
)
def exp_durations(spark, sf_dir):
    ended = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("completed_at"))
    )
    timed = read(spark, sf_dir, "orders").join(ended, "o_orderkey")
    return ex.with_duration(timed, "o_orderdate", "completed_at").select("o_orderkey", "duration_seconds")


_KEPT_SQL = f"NOT (created_at < {NOW_SQL} - INTERVAL 7 DAY AND status <> 'running')"


def _retained(spark, sf_dir):
    e = experiments(spark, sf_dir)
    now = F.lit(read(spark, sf_dir, "events").agg(F.max("ts").alias("m")).first()["m"])
    r = runs(spark, sf_dir).withColumn("experiment_id", F.col("id"))
    a = artifacts(spark, sf_dir).withColumn("experiment_id", F.col("id"))
    return ex.retain(e, r, a, now, days=7)


@query("exp_retention", f"SELECT id, competition, status, created_at FROM {EXPERIMENTS_SQL} WHERE {_KEPT_SQL}")
def exp_retention(spark, sf_dir):
    return _retained(spark, sf_dir)[0].select("id", "competition", "status", "created_at")


@query(
    "exp_retention_children",
    f"""SELECT 'runs' AS "table", COUNT(*) AS n FROM {EXPERIMENTS_SQL} WHERE {_KEPT_SQL}
UNION ALL SELECT 'artifacts', COUNT(*) FROM {EXPERIMENTS_SQL} WHERE {_KEPT_SQL}""",
)
def exp_retention_children(spark, sf_dir):
    _, kept_runs, kept_artifacts = _retained(spark, sf_dir)

    def size(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")

    return size(kept_runs, "runs").unionByName(size(kept_artifacts, "artifacts"))


@query(
    "exp_stage_status",
    f"""SELECT stage, CASE WHEN stage IN (SELECT stage FROM {RUNS_SQL} WHERE status = 'completed') THEN 'completed' ELSE 'remaining' END AS state
  FROM (VALUES ('view'), ('click'), ('purchase'), ('submission')) t(stage)""",
)
def exp_stage_status(spark, sf_dir):
    return ex.stage_status(runs(spark, sf_dir), ["view", "click", "purchase", "submission"])


@query(
    "exp_store",
    f"SELECT competition, status, COUNT(*) AS n, ROUND(SUM(duration_seconds), 4) AS seconds FROM {EXPERIMENTS_SQL} GROUP BY 1, 2",
)
def exp_store(spark, sf_dir):
    """Every experiment is appended as running, then again with its final state."""
    store = ExperimentStore(spark, new_shared_path(spark, "experiments"))
    rows = experiments(spark, sf_dir)
    store.append("experiments", rows.withColumn("status", F.lit("started")).drop("duration_seconds"))
    store.append("experiments", rows)
    kept = store.read("experiments").groupBy("competition", "status")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_seconds"), 4).alias("seconds"))


@query(
    "exp_metric_log",
    """SELECT CAST(user_id AS VARCHAR) AS experiment_id, event_type AS "key", value FROM events
  QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def exp_metric_log(spark, sf_dir):
    """Metrics are logged in two appends and read back as their last values."""
    store = ExperimentStore(spark, new_shared_path(spark, "experiments"))
    log = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"),
        F.col("event_type").alias("key"),
        "value",
        F.col("event_id").alias("seq"),
        F.col("ts").alias("logged_at"),
    )
    for half in (0, 1):
        store.log_metrics(log.where(F.col("seq") % 2 == half))
    return ex.latest_metrics(store.metric_log())


# ---- sources and sinks -----------------------------------------------------


@query("src_csv", "SELECT * FROM orders")
def src_csv(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    path = new_shared_path(spark, "orders") + ".csv"
    tables.write_table(orders, path)
    return tables.read_table(spark, path, orders.schema)


@query(
    "src_csv_inferred",
    "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def src_csv_inferred(spark, sf_dir):
    path = new_shared_path(spark, "customer") + ".csv"
    tables.write_table(read(spark, sf_dir, "customer"), path)
    return tables.read_table(spark, path)


@query("src_nan", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def src_nan(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return nan_to_null(read(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice")))


@query("src_peek", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def src_peek(spark, sf_dir):
    ordered = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    return tables.peek(ordered, 5)


@query("src_sample", "SELECT * FROM part ORDER BY p_partkey LIMIT 100")
def src_sample(spark, sf_dir):
    path = new_shared_path(spark, "part")
    tables.write_table(read(spark, sf_dir, "part"), path)
    return tables.first_rows(tables.read_table(spark, path), "p_partkey")


@query(
    "src_csv_shapes",
    """SELECT (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'customer') AS columns, COUNT(*) AS rows FROM customer""",
)
def src_csv_shapes(spark, sf_dir):
    """Shapes of the CSV files written from a table: together its columns and rows."""
    path = new_shared_path(spark, "shapes")
    read(spark, sf_dir, "customer").repartition(3).write.option("header", True).csv(path)
    found = tables.csv_shapes(spark, path)
    return found.agg(F.max("columns").cast("bigint").alias("columns"), F.sum("rows").alias("rows"))


@query("src_inventory")
def src_inventory(spark, sf_dir):
    return tables.file_inventory(spark, sf_dir)


@query("src_inventory_summary")
def src_inventory_summary(spark, sf_dir):
    return tables.inventory_summary(spark, sf_dir)


@query(
    "src_report",
    union_sql(
        ["c_custkey", "c_nationkey", "c_acctbal"],
        lambda c: f"""SELECT '{c}' AS "column", ROUND(AVG({c}), 6) AS mean, CAST(MAX({c}) AS DOUBLE) AS max FROM customer""",
    ),
)
def src_report(spark, sf_dir):
    path = new_shared_path(spark, "report")
    report = rounded(profile.describe(read(spark, sf_dir, "customer")))
    tables.write_report(report, path)
    schema = T.StructType([f for f in report.schema.fields if f.name in ("column", "mean", "max")])
    return spark.read.schema(schema).json(path)


@query(
    "src_predictions_wide",
    f"SELECT o_orderkey, pred_a, pred_b, pred_c FROM {PREDICTIONS_SQL}",
)
def src_predictions_wide(spark, sf_dir):
    """One table per model, put side by side by key, written and read back."""
    every = predictions(spark, sf_dir)
    a, b, c = (every.select("o_orderkey", m) for m in ("pred_a", "pred_b", "pred_c"))
    path = new_shared_path(spark, "predictions")
    tables.write_table(lookup.join_on_key(a, b, c, key="o_orderkey"), path)
    return tables.read_table(spark, path)
