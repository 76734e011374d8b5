"""The experiment tables: three append-only parquet tables and a metric log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

# The columns of the experiment tables.
SCHEMAS: dict[str, T.StructType] = {
    "experiments": T.StructType()
    .add("id", _S)
    .add("name", _S)
    .add("competition", _S)
    .add("created_at", _TS)
    .add("status", _S)
    .add("config", _S)
    .add("results", _S)
    .add("metrics", _S)
    .add("artifacts_path", _S)
    .add("duration_seconds", _D)
    .add("notes", _S),
    "runs": T.StructType()
    .add("id", _L)
    .add("experiment_id", _S)
    .add("stage", _S)
    .add("started_at", _TS)
    .add("completed_at", _TS)
    .add("status", _S)
    .add("metrics", _S)
    .add("logs", _S),
    "artifacts": T.StructType()
    .add("id", _L)
    .add("experiment_id", _S)
    .add("run_id", _L)
    .add("name", _S)
    .add("type", _S)
    .add("path", _S)
    .add("size_bytes", _L)
    .add("created_at", _TS)
    .add("metadata", _S),
}
METRIC_LOG = T.StructType().add("experiment_id", _S).add("key", _S).add("value", _D).add("seq", _L)


@dataclass
class ExperimentStore:
    """Tables under one folder; appending an id again supersedes its earlier row."""

    spark: SparkSession
    root: str

    def append(self, table: str, rows: DataFrame) -> None:
        schema = SCHEMAS[table]
        have = set(rows.columns)
        full = rows.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ],
            F.current_timestamp().alias("logged_at"),
        )
        full.write.mode("append").parquet(f"{self.root}/{table}")

    def log_metrics(self, rows: DataFrame) -> None:
        """Append ``experiment_id, key, value``; ``seq`` orders what is logged together."""
        have = set(rows.columns)
        stamp = F.col("logged_at") if "logged_at" in have else F.current_timestamp()
        full = rows.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in METRIC_LOG.fields
            ],
            stamp.cast(_TS).alias("logged_at"),
        )
        full.write.mode("append").parquet(f"{self.root}/metric_log")

    def metric_log(self) -> DataFrame:
        """Everything logged: the input of ``latest_metrics``."""
        stored = T.StructType([*METRIC_LOG.fields, T.StructField("logged_at", _TS)])
        return self.spark.read.schema(stored).parquet(f"{self.root}/metric_log")

    def read(self, table: str) -> DataFrame:
        """The latest row of every id; copies of an id collapse before the shuffle."""
        schema = SCHEMAS[table]
        stored = T.StructType([*schema.fields, T.StructField("logged_at", _TS)])
        rows = self.spark.read.schema(stored).parquet(f"{self.root}/{table}")
        rest = [f.name for f in schema.fields if f.name != "id"]
        latest = rows.groupBy("id").agg(F.max(F.struct("logged_at", *rest)).alias("r"))
        return latest.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
