"""Exact AUC of many weighted sums of the same prediction columns.

Tasks read the columns once and work out every weight vector's scores in numpy. Scores are dealt
by vector and range, equal ones of a chunk as one with its count, so a group holds one range of
one vector. A pair of rows in different ranges is counted from the ranges' class counts, a pair
within a range from its sorted scores. Rows with a missing prediction play no part, NaN is the
largest score; a label is 1 or not 1, and rows without a label are in no pair.

Arrays are shuffled byte by byte, the first bytes of all numbers first, and sorted scores as their
differences: the upper bytes are alike, and the shuffle's compression takes them away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted

#: Rows of a range, about: what one group holds of one weight vector.
RANGE_ROWS = 500_000
#: One of so many scores of a sorted chunk stands for its neighbours when ranges are cut.
STRIDE = 256
ACCURACY = 10_000
#: Bins whose counts one group adds up.
PIECE = 1024


def _rows(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """The label (1, 0, or -1 where it is missing) and the predictions of rows that have them all."""
    xs = [quoted(p).cast("double") for p in predictions]
    truth = F.when(F.col(y) == 1, 1).when(F.col(y).isNotNull(), 0).otherwise(-1).cast("byte")
    there = F.lit(True)
    for x in xs:
        there = there & x.isNotNull()
    return df.where(there).select(truth.alias("y"), *[x.alias(f"p{i}") for i, x in enumerate(xs)])


def _per_chunk(rows: DataFrame, candidates: Sequence[tuple[int, Sequence[float]]], size: int, start, schema: str) -> DataFrame:
    """``start()`` gives ``add(truth, scores) -> batches`` and ``end() -> batches`` of one task.

    ``add`` gets chunks of about ``size`` rows, the scores as pairs of number and array. All that
    runs in a task is nested, so that workers need not import this package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, end = start()
        held: list[pa.RecordBatch] = []

        def chunk() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            truth, *xs = (c.to_numpy() for c in table.columns)

            def scores() -> Iterator[tuple[int, np.ndarray]]:
                for k, weights in candidates:
                    # In the order of ``weighted_sum``, for the same doubles.
                    total = xs[0] * weights[0]
                    for x, w in zip(xs[1:], weights[1:], strict=True):
                        total = total + x * w
                    yield k, total

            with np.errstate(invalid="ignore", over="ignore"):
                yield from add(truth, scores())

        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= size:
                yield from chunk()
                held, count = [], 0
        if count:
            yield from chunk()
        yield from end()

    return rows.mapInArrow(run, schema)


def _packing() -> tuple[Callable[[np.ndarray], bytes], Callable[[bytes], np.ndarray]]:
    """``pack`` gives the bytes of 8-byte integers by their place in the number; ``unpack`` undoes it."""

    def pack(values: np.ndarray) -> bytes:
        return values.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()

    def unpack(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, len(data) // 8).T).view(np.int64).ravel()

    return pack, unpack


def _below(parts: DataFrame, place: str) -> DataFrame:
    """Add ``below``, the negatives of the candidate's lower places; there is one row per place."""
    before = Window.partitionBy("candidate").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))


def class_counts(
    df: DataFrame, y: str, predictions: Sequence[str], candidates: Sequence[tuple[int, Sequence[float]]], low: float, high: float, bins: Mapping[int, int]
) -> DataFrame:
    """``(candidate, pos, neg, least, most)``: pairs that are won for sure, and that may be won, by each candidate's ``bins``.

    Bins rise with the score, so only pairs of one bin are in doubt. A task sums its bins in arrays,
    which are added up by pieces. Without a labelled row there is no row.
    """
    width = (high - low) or 1.0
    pack, unpack = _packing()
    piece = PIECE

    def start():
        # The last bin is for NaN.
        counts = {k: np.zeros(2 * (bins[k] + 1), np.int64) for k, _ in candidates}

        def add(truth, scores):
            known, one = truth >= 0, truth == 1
            every = bool(known.all())
            for k, s in scores:
                n = bins[k]
                place = np.clip((s - low) / width * n, 0, n - 1)
                nan = np.isnan(s)
                if nan.any():
                    place[nan] = n
                place = place.astype(np.int64) + one * (n + 1)
                counts[k] += np.bincount(place if every else place[known], minlength=2 * (n + 1))
            return ()

        def end():
            for k, c in counts.items():
                both = c.reshape(2, -1)
                pieces = [(j, some) for j in range(-(-both.shape[1] // piece)) if (some := both[:, j * piece : (j + 1) * piece]).any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(pieces), pa.int32()), pa.array([j for j, _ in pieces], pa.int32()), pa.array([pack(some.ravel()) for _, some in pieces], pa.binary())],
                    names=["candidate", "piece", "counts"],
                )

        return add, end

    parts = _per_chunk(_rows(df, y, predictions), candidates, 1 << 16, start, "candidate int, piece int, counts binary")

    def bounds(table: pa.Table) -> pa.Table:
        neg, pos = sum(unpack(c.as_py()) for c in table.column("counts")).reshape(2, -1)
        below = np.cumsum(neg) - neg
        return pa.table(
            {
                "candidate": pa.array([table.column("candidate")[0].as_py()], pa.int32()),
                "piece": pa.array([table.column("piece")[0].as_py()], pa.int32()),
                "pos": [int(pos.sum())],
                "neg": [int(neg.sum())],
                "least": [float(pos @ below)],
                "most": [float(pos @ (below + neg))],
            }
        )

    summed = parts.groupBy("candidate", "piece").applyInArrow(bounds, "candidate int, piece int, pos long, neg long, least double, most double")
    sure = F.col("pos").cast("double") * F.col("below")
    return _below(summed, "piece").groupBy("candidate").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("least") + sure).alias("least"), F.sum(F.col("most") + sure).alias("most")
    )


def score_ranges(
    df: DataFrame, y: str, predictions: Sequence[str], candidates: Sequence[tuple[int, Sequence[float]]], count: int, range_rows: int = RANGE_ROWS
) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Cuts of every candidate's scores into equal parts of about ``range_rows``, and how many scores :func:`exact_auc` deals, about.

    Results do not depend on the cuts. ``count`` is the rows of ``df``, about; those of one range need no cuts.
    """
    ranges = -(-count // range_rows)
    if ranges < 2:
        return {}, {k: count for k, _ in candidates}
    stride = STRIDE

    def start():
        def add(truth, scores):
            for k, s in scores:
                s = np.sort(s)
                some = s[min(stride // 2, len(s) // 2) :: stride]
                some = some[np.isfinite(some)]
                # The number of different scores comes once.
                levels = np.zeros(max(1, len(some)), np.int64)
                levels[0] = 1 + np.count_nonzero(s[1:] != s[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(levels), pa.int32()), pa.array(some if len(some) else [None], pa.float64()), pa.array(levels)], names=["candidate", "v", "levels"]
                )

        return add, lambda: ()

    some = _per_chunk(_rows(df, y, predictions), candidates, 1 << 18, start, "candidate int, v double, levels long")
    probs = [i / ranges for i in range(1, ranges)]
    # One row per candidate.
    found = some.groupBy("candidate").agg(F.percentile_approx("v", probs, ACCURACY).alias("cuts"), F.sum("levels").alias("levels")).collect()
    cuts = {r["candidate"]: np.unique(np.array(r["cuts"] or [], np.float64)) for r in found}
    return cuts, {r["candidate"]: r["levels"] for r in found}


def exact_auc(
    df: DataFrame,
    y: str,
    predictions: Sequence[str],
    candidates: Sequence[tuple[int, Sequence[float]]],
    count: int,
    range_rows: int = RANGE_ROWS,
    edges: Mapping[int, np.ndarray] | None = None,
) -> DataFrame:
    """``(candidate, auc)`` of numbered weight vectors, ties counted half; ``count`` is the rows of ``df``, about.

    ``edges`` are the cuts of :func:`score_ranges` where the caller has them.
    """
    rows = _rows(df, y, predictions)
    if edges is None:
        edges = score_ranges(df, y, predictions, candidates, count, range_rows)[0]
    none = np.zeros(0)
    pack, unpack = _packing()

    def start():
        def add(truth, scores):
            one, zero = truth == 1, truth == 0
            for k, s in scores:
                cuts = edges.get(k, none)
                ranges, classes, levels, counts = [], [], [], []
                for positive, mask in ((True, one), (False, zero)):
                    v, n = np.unique(s[mask], return_counts=True)
                    # A score at a cut is above it, as are its equals.
                    at = [0, *np.searchsorted(v, cuts, "left").tolist(), len(v)]
                    for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        if a < b:
                            ranges.append(j)
                            classes.append(positive)
                            levels.append(pack(np.diff(v[a:b].view(np.int64), prepend=0)))
                            counts.append(pack(n[a:b]) if (n[a:b] > 1).any() else b"")
                if not ranges:
                    # No labels here: the candidate still has its row.
                    ranges, classes, levels, counts = [0], [True], [b""], [b""]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(ranges), pa.int32()),
                        pa.array(ranges, pa.int32()),
                        pa.array(classes, pa.bool_()),
                        pa.array(levels, pa.binary()),
                        pa.array(counts, pa.binary()),
                    ],
                    names=["candidate", "range", "positive", "levels", "counts"],
                )

        return add, lambda: ()

    schema = "candidate int, range int, positive boolean, levels binary, counts binary"
    dealt = _per_chunk(rows, candidates, 1 << 20, start, schema)

    def within(table: pa.Table) -> pa.Table:
        def of(positive: bool) -> tuple[np.ndarray, np.ndarray]:
            levels, counts = [none], [np.zeros(0, np.int64)]
            for p, v, n in zip(table.column("positive"), table.column("levels"), table.column("counts"), strict=True):
                if p.as_py() == positive:
                    own, many = np.cumsum(unpack(v.as_py())).view(np.float64), n.as_py()
                    levels.append(own)
                    counts.append(unpack(many) if many else np.ones(len(own), np.int64))
            v, n = np.concatenate(levels), np.concatenate(counts)
            order = np.argsort(v)
            return v[order], n[order]

        (pos, several), (neg, many) = of(True), of(False)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        halves = (several * (upto[np.searchsorted(neg, pos, "left")] + upto[np.searchsorted(neg, pos, "right")])).sum()
        return pa.table(
            {
                "candidate": pa.array([table.column("candidate")[0].as_py()], pa.int32()),
                "range": pa.array([table.column("range")[0].as_py()], pa.int32()),
                "pos": [int(several.sum())],
                "neg": [int(many.sum())],
                "won": [float(halves) / 2],
            }
        )

    parts = dealt.groupBy("candidate", "range").applyInArrow(within, "candidate int, range int, pos long, neg long, won double")
    summed = _below(parts, "range").groupBy("candidate").agg(
        F.sum(F.col("won") + F.col("pos").cast("double") * F.col("below")).alias("won"),
        (F.sum("pos").cast("double") * F.sum("neg")).alias("pairs"),
    )
    return summed.select("candidate", F.when(F.col("pairs") > 0, F.col("won") / F.nullif("pairs", F.lit(0.0))).alias("auc"))
