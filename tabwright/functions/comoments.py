"""Pairwise co-moments of any number of columns with gaps, merged stably.

A task makes matrix products over blocks of columns and keeps, for every pair, the rows that hold
both values, their means and centred products. Pairs whose products cancel are taken again around
a value of their own. What the tasks found is merged by Spark: around the mean of all, one window
over a pair's parts and one sum. No column's overall mean or spread enters, so what a column does
where its partner is missing has no part in the pair, and the driver sees no matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted

# A task holds six numbers for every pair of two blocks.
BLOCK = 256
_ROWS = 4096
# Below this share of the raw products, the centred ones have lost too many digits.
_CANCELLED = 1e-5
_SCHEMA = "i int, j int, n double, mi double, mj double, sii double, sjj double, sij double"


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments ``(n, mi, mj, sii, sjj, sij)`` of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    di, dj = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    return np.stack(
        [n, a[1] + di * share, a[2] + dj * share, a[3] + b[3] + di * di * both, a[4] + b[4] + dj * dj * both, a[5] + b[5] + di * dj * both]
    )


def _pair(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Co-moments of one pair over its complete rows, around its first ones."""
    x0, y0 = x[0], y[0]
    dx, dy = x - x0, y - y0
    mx, my = dx.mean(), dy.mean()
    cx, cy = dx - mx, dy - my
    return len(x), x0 + mx, y0 + my, cx @ cx, cy @ cy, cx @ cy


def co_moments(x: np.ndarray, here_x: np.ndarray, y: np.ndarray, here_y: np.ndarray) -> np.ndarray:
    """Six matrices for all pairs of a column of ``x`` and one of ``y``, of rows where both are present."""

    def moved(v: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = v[here.argmax(axis=0), np.arange(v.shape[1])]
        start = np.where(here.any(axis=0), first, 0.0)
        return np.where(here, v - start, 0.0), start

    (dx, x0), (dy, y0) = moved(x, here_x), moved(y, here_y)
    px, py = here_x.astype(float), here_y.astype(float)
    n = px.T @ py
    size = np.maximum(n, 1.0)
    sx, sy = dx.T @ py, px.T @ dy
    qx, qy = (dx * dx).T @ py, px.T @ (dy * dy)
    out = np.stack([n, x0[:, None] + sx / size, y0[None, :] + sy / size, qx - sx * sx / size, qy - sy * sy / size, dx.T @ dy - sx * sy / size])
    out[1:, n == 0] = 0.0
    cancelled = (n > 0) & (((out[3] <= _CANCELLED * qx) & (qx > 0)) | ((out[4] <= _CANCELLED * qy) & (qy > 0)))
    for i, j in zip(*np.nonzero(cancelled), strict=True):
        rows = here_x[:, i] & here_y[:, j]
        out[:, i, j] = _pair(x[rows, i], y[rows, j])
    return out


def _block_task(first: Sequence[int], second: Sequence[int]):
    """Co-moments of the pairs of two blocks of columns, ``i < j`` only, of all rows of a task."""
    same = first == second
    columns = [f"x{i}" for i in ([*first] if same else [*first, *second])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(first), len(second)))
        infinite = np.zeros((len(first), len(second)), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                v = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
                here = ~np.isnan(v)
                odd = np.isinf(v)
                v = np.where(here & ~odd, v, 0.0)
                a = slice(0, len(first))
                b = a if same else slice(len(first), None)
                if odd.any():
                    o, p = odd.astype(float), here.astype(float)
                    infinite |= (o[:, a].T @ p[:, b] + p[:, a].T @ o[:, b]) > 0
                total = _merge(total, co_moments(v[:, a], here[:, a], v[:, b], here[:, b]))
        total[5][infinite] = np.nan
        i, j = np.repeat(first, len(second)), np.tile(second, len(first))
        kept = i < j
        arrays = [i[kept].astype(np.int32), j[kept].astype(np.int32), *(m.ravel()[kept] for m in total)]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return run


def pair_moments(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``i, j, n, mi, mj, sii, sjj, sij`` of every pair of places ``i < j`` in ``columns``.

    ``n`` rows hold both values (NaN counts as a gap), ``mi`` and ``mj`` are their means there and
    ``s..`` their centred products; an infinite value makes ``sij`` NaN. More than ``block`` columns
    are read block by block, each scan with the columns of two blocks.
    """
    spark = df.sparkSession
    k = len(columns)
    blocks = [range(s, min(s + block, k)) for s in range(0, k, block)]
    none = [F.lit(0.0).alias(c.split()[0]) for c in _SCHEMA.split(", ")[2:]]
    places = F.explode(F.sequence(F.col("id").cast("int") + 1, F.lit(k - 1)))
    # Every pair is there, even without a row.
    parts = spark.range(max(k - 1, 0)).select(F.col("id").cast("int").alias("i"), places.alias("j"), *none)
    for first, second in combinations_with_replacement(blocks, 2):
        used = sorted({*first, *second})
        values = df.select(*[quoted(columns[i]).cast("double").alias(f"x{i}") for i in used])
        parts = parts.union(values.mapInArrow(_block_task(first, second), _SCHEMA))
    pair = Window.partitionBy("i", "j")
    total = F.sum("n").over(pair)
    size = F.greatest(total, F.lit(1.0))
    around = parts.select(
        "*",
        total.alias("rows"),
        (F.sum(F.col("n") * F.col("mi")).over(pair) / size).alias("ai"),
        (F.sum(F.col("n") * F.col("mj")).over(pair) / size).alias("aj"),
    )
    n, di, dj = F.col("n"), F.col("mi") - F.col("ai"), F.col("mj") - F.col("aj")
    # Parts of equal mean add nothing, whatever the last digit of the mean of means.
    di, dj = (F.when(F.min(m).over(pair) == F.max(m).over(pair), F.lit(0.0)).otherwise(d) for m, d in (("live_i", di), ("live_j", dj)))
    live = around.withColumns({"live_i": F.when(n > 0, F.col("mi")), "live_j": F.when(n > 0, F.col("mj"))})
    moved = live.select("*", di.alias("di"), dj.alias("dj"))
    return moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.first("ai").alias("mi"),
        F.first("aj").alias("mj"),
        F.sum(F.col("sii") + n * F.col("di") * F.col("di")).alias("sii"),
        F.sum(F.col("sjj") + n * F.col("dj") * F.col("dj")).alias("sjj"),
        F.sum(F.col("sij") + n * F.col("di") * F.col("dj")).alias("sij"),
    )
