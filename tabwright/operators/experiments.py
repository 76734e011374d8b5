"""Experiment history as tables: list, best, compare, merge, report, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small

# Status words and defaults of the experiment tables.
COMPLETED = "completed"
RUNNING = "running"
RETENTION_DAYS = 30
LIST_LIMIT = 20
BYTES_PER_MB = 1024 * 1024
MAX_METRICS = 10_000


def list_experiments(
    experiments: DataFrame,
    competition: str | None = None,
    status: str | None = None,
    limit: int | None = LIST_LIMIT,
) -> DataFrame:
    """Newest first, filtered before anything is sorted."""
    if competition is not None:
        experiments = experiments.where(F.col("competition") == competition)
    if status is not None:
        experiments = experiments.where(F.col("status") == status)
    ordered = experiments.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def _metric(column: str, metric: str) -> Column:
    return F.from_json(column, "map<string,string>").getItem(metric).try_cast("double")


def best_experiments(experiments: DataFrame, metric: str, minimize: bool = False) -> DataFrame:
    """``(competition, id, value)``: the best completed experiment of every competition.

    Ties go to the newest, then to the smallest id.
    """
    scored = experiments.where(F.col("status") == COMPLETED).select(
        "competition", "id", "created_at", _metric("metrics", metric).alias("value")
    )
    scored = scored.where(F.col("value").isNotNull())
    sign = 1 if minimize else -1
    rank = F.struct((sign * F.col("value")).alias("v"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id")
    return scored.groupBy("competition").agg(F.min(rank).alias("b")).select(
        "competition", F.col("b.id").alias("id"), (sign * F.col("b.v")).alias("value")
    )


def metric_names(experiments: DataFrame) -> list[str]:
    """Distinct metric names; each becomes a column, so there must not be too many."""
    keys = F.explode(F.map_keys(F.from_json("metrics", "map<string,string>")))
    found = experiments.select(keys.alias("k")).distinct().limit(MAX_METRICS + 1).collect()
    if len(found) > MAX_METRICS:
        raise ValueError(f"more than {MAX_METRICS} metric names: name some, or use metric_values")
    return sorted(r["k"] for r in found)


def metric_values(experiments: DataFrame) -> DataFrame:
    """``(id, metric, value)``: every metric of every experiment, whatever their number; no number is NULL."""
    parsed = F.from_json("metrics", "map<string,string>")
    long = experiments.select("id", F.explode(parsed).alias("metric", "value"))
    return long.withColumn("value", F.col("value").try_cast("double"))


def compare_experiments(experiments: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per experiment with a ``metric_*`` column per metric and its duration."""
    names = list(metrics) if metrics is not None else metric_names(experiments)
    parsed = experiments.withColumn("__m", F.from_json("metrics", "map<string,string>"))
    flat = [F.col("__m").getItem(n).try_cast("double").alias(f"metric_{n}") for n in names]
    plain = [c for c in ("id", "name", "competition", "status", "created_at", "duration_seconds") if c in experiments.columns]
    return parsed.select(*plain, *flat)


def latest_metrics(log: DataFrame) -> DataFrame:
    """``(experiment_id, key, value)``: the last logged value of every metric.

    ``log`` has ``(experiment_id, key, value, logged_at, seq)``; the largest entry is
    kept by a combining aggregate, so a busy experiment is reduced before the shuffle.
    """
    last = F.max(F.struct("logged_at", "seq", "value"))
    return log.groupBy("experiment_id", "key").agg(last.alias("l")).select(
        "experiment_id", "key", F.col("l.value").alias("value")
    )


def merge_metrics(old: str, new: str) -> Column:
    """Two JSON objects in one, entries of the second winning."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def with_duration(df: DataFrame, start: str = "created_at", end: str = "completed_at") -> DataFrame:
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return df.withColumn("duration_seconds", micros / 1e6)


def run_report(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """``(id, name, stage, status, runs, first_started)``: runs of every experiment by stage.

    Runs are counted by experiment and stage before the join.
    """
    stages = runs.groupBy("experiment_id", "stage", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first_started")
    )
    heads = experiments.select("id", "name")
    return heads.join(stages, F.col("id") == F.col("experiment_id"), "left").drop("experiment_id")


def artifact_report(experiments: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(id, type, artifacts, size_mb)`` for every experiment."""
    sizes = artifacts.groupBy("experiment_id", "type").agg(
        F.count(F.lit(1)).alias("artifacts"), (F.sum("size_bytes") / BYTES_PER_MB).alias("size_mb")
    )
    heads = experiments.select("id")
    return heads.join(sizes, F.col("id") == F.col("experiment_id"), "left").drop("experiment_id")


def expired(experiments: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Ids of experiments that ended and are older than ``days``."""
    cutoff = now - F.make_interval(days=F.lit(days))
    old = (F.col("created_at") < cutoff) & (F.col("status") != RUNNING)
    return experiments.where(old).select("id")


def retain(
    experiments: DataFrame, runs: DataFrame, artifacts: DataFrame, now: Column, days: int = RETENTION_DAYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without expired experiments and what belongs to them."""
    gone = broadcast_if_small(expired(experiments, now, days))
    children = gone.withColumnRenamed("id", "experiment_id")
    return (
        experiments.join(gone, "id", "left_anti"),
        runs.join(children, "experiment_id", "left_anti"),
        artifacts.join(children, "experiment_id", "left_anti"),
    )


def stage_status(runs: DataFrame, stages: Sequence[str]) -> DataFrame:
    """``(stage, state)``: completed where some run of the stage completed, else remaining."""
    done = runs.where(F.col("status") == COMPLETED).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    listed = runs.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    state = F.when(F.col("n").isNotNull(), "completed").otherwise("remaining")
    return listed.join(done, "stage", "left").select("stage", state.alias("state"))
