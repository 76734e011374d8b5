"""Read and write tables, samples and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null

SAMPLE_ROWS = 100


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A parquet or CSV table, NaN read as missing.

    A CSV without a schema is scanned once more to infer one.
    """
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def header(df: DataFrame) -> list[str]:
    return df.columns


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, or CSV with a header where the path says so."""
    if path.rstrip("/").lower().endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def first_rows(df: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by key: a top-k, not a full sort."""
    return df.orderBy(key).limit(rows)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report table as JSON lines."""
    report.write.mode(mode).json(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(name, extension, size_bytes)``: names and lengths only, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        F.col("length").alias("size_bytes"),
    )


def inventory_summary(spark: SparkSession, path: str) -> DataFrame:
    """Files and total bytes per extension."""
    files = file_inventory(spark, path)
    return files.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def csv_shapes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, columns, rows)`` of every CSV file under ``path``.

    Only headers are read by the driver; records are counted in one job, parsed,
    so that a quoted line break does not count as a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.where(F.lower("path").endswith(".csv")).select("path").collect()
    paths = [r["path"] for r in listed]
    schema = "name string, columns int, rows bigint"
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("multiLine", True)
    widths = [(p, p.rsplit("/", 1)[-1], len(reader.csv(p).columns)) for p in paths]
    heads = spark.createDataFrame(widths, "path string, name string, columns int")
    counted = (
        reader.schema("first string")
        .csv(paths)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # One row per file on both sides.
    met = heads.join(counted, "path", "left")
    return met.select("name", "columns", F.coalesce("rows", F.lit(0)).alias("rows"))
