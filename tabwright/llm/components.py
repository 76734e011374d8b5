"""Connected components of a graph given as an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, without loops or repeats."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes with an edge.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type. Each round rewrites
    the edges so that components become stars; every round's edges are written to the
    shared folder. Aggregates combine before the shuffle, and no neighbourhood is gathered
    in one place, so a node with very many edges does no harm. The rounds end when the
    stars no longer change.
    """
    now = cut_lineage(_oriented(edges))
    state = _fingerprint(now)
    while state[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        new = _fingerprint(now)
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed % 1_000_003).alias("s")).first()
    return (row["n"], row["x"], row["s"])
