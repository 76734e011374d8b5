"""Registry of the checked queries and their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its check where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, **by_column: int) -> DataFrame:
    """Double columns rounded, so that summation order cannot show."""
    return df.select(
        *[
            F.round(f.name, by_column.get(f.name, places)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def union_sql(columns: Sequence[str], part: Callable[[str], str]) -> str:
    return "\nUNION ALL\n".join(part(c) for c in columns)


def blank(condition: Column, column: str) -> Column:
    """The column with NULL where the condition holds."""
    return F.when(~condition, F.col(column)).alias(column)


# Orders with missing values: a quarter of the prices, a tenth of the priorities
# and nine tenths of the customer keys.
GAPS_SQL = """(SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 < 9 THEN NULL ELSE o_custkey END AS o_custkey,
    o_orderstatus,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        blank(key % 10 < 9, "o_custkey"),
        "o_orderstatus",
        blank(key % 4 == 0, "o_totalprice"),
        "o_orderdate",
        blank(key % 10 == 0, "o_orderpriority"),
    )


# Train is four fifths of the orders, test the rest; test also has a category
# train never saw.
TEST_SQL = "o_orderkey % 5 = 0"


def is_test() -> Column:
    return F.col("o_orderkey") % 5 == 0


UNSEEN_SQL = f"""(SELECT * REPLACE (CASE WHEN {TEST_SQL} AND o_custkey % 50 = 0 THEN 'NEW'
    ELSE o_orderpriority END AS o_orderpriority) FROM orders)"""


def orders_with_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = is_test() & (F.col("o_custkey") % 50 == 0)
    changed = F.when(new, F.lit("NEW")).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").withColumn("o_orderpriority", changed)


# Predictions of three models for a 0/1 label on every order.
PREDICTIONS_SQL = """(SELECT o_orderkey, o_custkey, o_orderkey % 5 AS fold,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    LEAST(GREATEST(o_totalprice / 500000.0, 0.001), 0.999) AS pred_a,
    LEAST(GREATEST((o_orderkey % 97) / 97.0::DOUBLE, 0.001), 0.999) AS pred_b,
    LEAST(GREATEST((o_custkey % 11) / 11.0::DOUBLE, 0.001), 0.999) AS pred_c
  FROM orders)"""
MODELS = ["pred_a", "pred_b", "pred_c"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))

    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_orderkey") % 5).alias("fold"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        held(F.col("o_totalprice") / 500000.0).alias("pred_a"),
        held((F.col("o_orderkey") % 97) / 97.0).alias("pred_b"),
        held((F.col("o_custkey") % 11) / 11.0).alias("pred_c"),
    )


VALUES_SQL = """(SELECT o_orderkey, o_orderkey % 5 AS fold, o_totalprice AS y,
    0.9::DOUBLE * o_totalprice + 1000.0::DOUBLE * (o_custkey % 7) AS pred_a,
    250000.0::DOUBLE AS pred_b,
    0.5::DOUBLE * o_totalprice + 120000.0::DOUBLE AS pred_c
  FROM orders)"""


def value_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 5).alias("fold"),
        y.alias("y"),
        (y * 0.9 + (F.col("o_custkey") % 7) * 1000.0).alias("pred_a"),
        F.lit(250000.0).alias("pred_b"),
        (y * 0.5 + 120000.0).alias("pred_c"),
    )


# Experiments and their runs and artifacts, read from the event stream.
EXPERIMENTS_SQL = """(SELECT event_id AS id, 'run ' || event_id AS name, event_type AS competition, ts AS created_at,
    CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status,
    props AS metrics, value AS duration_seconds
  FROM events)"""
RUNS_SQL = """(SELECT event_id AS id, user_id AS experiment_id, event_type AS stage, ts AS started_at,
    CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status
  FROM events)"""
ARTIFACTS_SQL = """(SELECT event_id AS id, user_id AS experiment_id, event_type AS type,
    CAST(value * 1000 AS BIGINT) AS size_bytes, ts AS created_at
  FROM events)"""


def _status() -> Column:
    third = F.col("event_id") % 3
    return (
        F.when(third == 0, "completed").when(third == 1, "failed").otherwise("running").alias("status")
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("name"),
        F.col("event_type").alias("competition"),
        F.col("ts").alias("created_at"),
        _status(),
        F.col("props").alias("metrics"),
        F.col("value").alias("duration_seconds"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("experiment_id"),
        F.col("event_type").alias("stage"),
        F.col("ts").alias("started_at"),
        _status(),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("experiment_id"),
        F.col("event_type").alias("type"),
        F.round(F.col("value") * 1000).cast("bigint").alias("size_bytes"),
        F.col("ts").alias("created_at"),
    )


LABELLED_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")
