"""Documents to packed token sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import decontaminate, line_dedup, packing, shingles, toxicity
from tabwright.session import cut_lineage


def _with_length(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``; a column ``n_chars`` follows the text."""
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), size).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.fit(docs, labels).score(docs, column="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all documents but the first that has them."""
    return _with_length(docs, line_dedup.drop_repeated_lines(docs, counted=("__lines_before", "__lines_gone")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash candidates, similarity 0.8 or more on five-word shingles) the smallest id stays."""
    return shingles.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_length(docs, decontaminate.decontaminate(docs, items))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents that fill sequences in the sources' proportions."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# Fingerprints, fitted scores and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
