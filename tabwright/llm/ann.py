"""Nearest neighbours by largest inner product, with cross-polytope hashing.

A vector of unit length is rotated by a fast pseudo-random rotation (three rounds of random
signs and a Hadamard transform) and assigned to the nearest signed axis. Several tables with
rotations of their own are built; a query probes the axes nearest to it in each. Candidates
are compared exactly, in double precision, on the original vectors.

Every vector is in every table. A table's buckets are split into cells of bounded size, and a
cell's task compares a few thousand vectors with a block of the queries that probe it. Equal
vectors can fill a ranking only with their smallest ids, so of each distinct vector the
``neighbours + 1`` smallest ids are kept: results are the same, and a vector that a third of
all rows hold does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import partitions, ship

NEIGHBOURS = 20
TABLES = 16
PROBES = 8
CELL_ROWS = 4096
CELL_QUERIES = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def rotated(x: np.ndarray, table: int, turn: int = 0) -> np.ndarray:
    """Rows after the pseudo-random rotation of a table; short rows are padded with zeros."""
    size = 1 << max(0, int(x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([table, turn, x.shape[1]]).choice([-1.0, 1.0], (3, size))
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def _axes(x: np.ndarray) -> np.ndarray:
    """Closeness to all signed axes: axis j is +e_j, axis size + j is -e_j."""
    return np.concatenate([x, -x], 1)


def buckets(x: np.ndarray, table: int, probes: int = 1, turns: int = 1) -> np.ndarray:
    """The ``probes`` nearest buckets of each row, nearest first.

    With ``turns`` > 1 a bucket is a tuple of that many axes of independent rotations, and
    the tuples with the largest sum of closeness are probed.
    """
    places = np.zeros((len(x), 1), np.int64)
    score = np.zeros((len(x), 1))
    for t in range(turns):
        near = _axes(rotated(x, table, t))
        m = min(probes, near.shape[1])
        top = np.argsort(-near, axis=1, kind="stable")[:, :m]
        value = np.take_along_axis(near, top, 1)
        places = (places[:, :, None] * near.shape[1] + top[:, None, :]).reshape(len(x), -1)
        score = (score[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        places, score = np.take_along_axis(places, best, 1), np.take_along_axis(score, best, 1)
    return places


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed in the order of the components."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], v.shape[:-1]))
    for k in range(q.shape[-1]):
        out += q[..., k] * v[..., k]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id``, ``v`` and ``d`` (length) of the vectors that take part."""
    v = F.col(embedding)
    fine = (
        v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("d")
    )


def _hashed(rows: DataFrame, tables: int, probes: int, turns: int) -> DataFrame:
    """A row per table and probed bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), 1024):
                    part = b.take(pa.array(at[lo : lo + 1024]))
                    x = _matrix(part.column("v"))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(tables):
                        found = buckets(x, t, probes, turns)
                        row = np.repeat(np.arange(len(x)), found.shape[1])
                        taken = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(taken.column(c) for c in ("id", "v", "d")),
                                pa.array(np.full(len(row), t, np.int32)),
                                pa.array(found.ravel()),
                            ],
                            names=["id", "v", "d", "t", "bucket"],
                        )

    return rows.mapInArrow(run, "id long, v array<double>, d int, t int, bucket long")


def _best(pairs: DataFrame, neighbours: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)


def _compare(cells: DataFrame, queries: DataFrame, on: list[str], neighbours: int) -> DataFrame:
    """The nearest rows of every cell for each of its queries."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.combine_chunks().sort_by("id"), right.combine_chunks()
        v, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        vid, qid = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = []
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            rough = part @ v.T
            rough[qid[lo : lo + 256, None] == vid[None, :]] = -np.inf
            # What may be among the nearest after rounding is summed again, one order for all.
            k = min(neighbours, rough.shape[1]) - 1
            least = np.partition(rough, rough.shape[1] - 1 - k, axis=1)[:, rough.shape[1] - 1 - k]
            slack = 1e-12 * np.linalg.norm(part, axis=1) * np.sqrt((v * v).sum(1).max())
            row, col = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
            score = products(part[row], v[col])
            order = np.lexsort((vid[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, np.arange(len(part)))
            keep = np.arange(len(row)) - first[row] < neighbours
            found.append((qid[lo + row[keep]], vid[col[keep]], score[keep]))
        return pa.table(dict(zip(["query_id", "vec_id", "score"], (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    return cells.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _pieces(n: str, size: int) -> Column:
    return F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(0)) / size), F.lit(1)).cast("int")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    neighbours: int = NEIGHBOURS,
    tables: int = TABLES,
    probes: int = PROBES,
    turns: int = 1,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cell_rows: int = CELL_ROWS,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """Nearest found vectors of each query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows for which ``is_query`` (over ``vec_id``) holds, candidates all other
    rows than the query's own. Score is the inner product of the original vectors; nearest
    first, ties to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part; vectors of different lengths are not compared; rows without an
    id are left out; of rows that repeat an id and a vector one counts. A query that found
    fewer than ``neighbours`` is compared with all vectors, in blocks, so it gets all
    candidates if there are fewer. An empty table gives no rows. More ``turns`` make more,
    smaller buckets, for tables of many millions of rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut_lineage(usable(vectors, vec_id, embedding).dropDuplicates())
    same = W.partitionBy("v").orderBy("id")
    held = cut_lineage(
        rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= neighbours + 1).drop("__n")
    )
    asked = cut_lineage(rows.withColumn(vec_id, F.col("id")).where(is_query).select("id", "v", "d"))
    index = cut_lineage(_hashed(held, tables, 1, turns))
    probe = cut_lineage(_hashed(asked, tables, probes, turns))
    on = ["d", "t", "bucket"]
    cell = [*on, "vc", "qc"]
    sizes = index.groupBy(*on).agg(F.count(F.lit(1)).alias("nv")).join(
        probe.groupBy(*on).agg(F.count(F.lit(1)).alias("nq")), on, "inner"
    )
    sizes = cut_lineage(sizes.select(*on, _pieces("nv", cell_rows).alias("pv"), _pieces("nq", cell_queries).alias("pq")))

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        """A row goes to one piece of its own side and to all pieces of the other."""
        names = {"pv": "vc", "pq": "qc"}
        return (
            table.join(sizes, on)
            .withColumn(names[own], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            .withColumn(names[other], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("id", "v", *cell)
        )

    n = partitions(vectors)
    pairs = _compare(dealt(index, "pv", "pq"), dealt(probe, "pq", "pv"), cell, neighbours)
    found = cut_lineage(_best(pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), neighbours))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= neighbours)
    short = cut_lineage(asked.join(full, asked["id"] == full["query_id"], "left_anti"))
    if not short.isEmpty():
        blocks = max(n, 1)
        left = held.select("id", "v", "d", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        right = short.select("id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        more = _best(_compare(left, right, ["d", "block"], neighbours), neighbours)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
