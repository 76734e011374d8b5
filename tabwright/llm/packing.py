"""Pack token ids into fixed-length sequences with controlled source proportions.

Each source is a queue of tokens. A schedule gives every source its share of the stream:
queues are served in proportion to their targets, and when one is drained the others go
on in proportion. The stream is cut into blocks of about ``BLOCK_TOKENS`` tokens. How much
of a queue precedes a block follows from the schedule in closed form, so a source's deficit
(what it was due less what it got) is carried over block and partition borders without
any task waiting for another; it stays below one token there. Inside a block a deficit
round-robin fills windows of one sequence each: a window's tokens are credited to the
sources by their shares, the source with the largest deficit is served next, at least
``LEAST_PIECE`` tokens at a time, and what is over- or underserved is carried to the next
window.

Only totals per source reach the driver (one row per source), for the schedule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ship, tidy
from .tokens import default_tokenizer, encoder, id_type, slices

SEQUENCE_TOKENS = 1024
BLOCK_TOKENS = 1 << 20
LEAST_PIECE = 128
FEW_QUEUES = 64
MAX_BROADCAST_ROWS = 200_000


@dataclass
class Schedule:
    """When each queue's tokens are due, as block numbers.

    ``v`` is virtual time: an undrained queue ``s`` has been served ``weight[s] * v``.
    """

    tokens: np.ndarray
    weight: np.ndarray
    blocks: int

    def __post_init__(self) -> None:
        drained = self.tokens / self.weight
        order = np.argsort(drained, kind="stable")
        self.times = np.concatenate([[0.0], drained[order]])
        rate = self.weight.sum() - np.concatenate([[0.0], np.cumsum(self.weight[order])[:-1]])
        self.served = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * np.maximum(rate, 0.0))])
        self.total = int(self.tokens.sum())
        self.block_tokens = self.total / self.blocks

    def before(self, queue: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Tokens of the queue that precede the block."""
        time = np.interp(block * self.block_tokens, self.served, self.times)
        due = np.minimum(self.tokens[queue], np.floor(self.weight[queue] * time)).astype(np.int64)
        return np.where(block >= self.blocks, self.tokens[queue], np.where(block <= 0, 0, due))

    def block_of(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The block that holds the token at a position of its queue."""
        due = np.interp(position / self.weight[queue], self.times, self.served)
        block = np.clip((due / self.block_tokens).astype(np.int64), 0, self.blocks - 1)
        while (late := self.before(queue, block) > position).any():
            block = block - late
        while (early := self.before(queue, block + 1) <= position).any():
            block = block + early
        return block


def deal(sizes: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Deficit round-robin over queues of ``sizes`` tokens: who is served, and how much.

    No serving crosses a window's border; every window but the last is filled.
    """
    total = int(sizes.sum())
    share = sizes / max(total, 1)
    left = sizes.tolist()
    few = len(left) <= FEW_QUEUES
    # A drained queue's deficit stays at minus infinity, so it is served no more.
    deficit = [0.0] * len(left) if few else np.zeros(len(left))
    credit = (share * window).tolist() if few else share * window
    queues = range(len(left))
    who: list[int] = []
    much: list[int] = []
    done = 0
    while done < total:
        room = min(window, total - done)
        if room < window:
            credit = (share * room).tolist() if few else share * room
        deficit = [d + c for d, c in zip(deficit, credit, strict=True)] if few else deficit + credit
        done += room
        while room:
            s = max(queues, key=deficit.__getitem__) if few else int(np.argmax(deficit))
            n = min(room, left[s], max(least, int(deficit[s])))
            left[s] -= n
            deficit[s] = deficit[s] - n if left[s] else -math.inf
            room -= n
            who.append(s)
            much.append(n)
    return np.array(who, np.int64), np.array(much, np.int64)


def _tokenized(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str, source: str | None) -> DataFrame:
    """Every document's ids, its queue, and its place among the queue's rows of its input split."""
    queue = F.lit("") if source is None else F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), queue.alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"part long, queue string, first long, id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        filled: dict[str, int] = {}
        for b in slices(batches):
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            counts = [len(x) // enc.dtype.itemsize for x in ids]
            queues = b.column("queue").to_pylist()
            first = []
            for q, n in zip(queues, counts, strict=True):
                first.append(filled.get(q, 0))
                filled[q] = first[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int64()),
                    b.column("queue"),
                    pa.array(first, pa.int64()),
                    b.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["part", "queue", "first", "id", "n_tokens", "ids"],
            )

    return rows.mapInArrow(tidy(run, encodes=True), schema)


def _weights(queues: list[str], tokens: np.ndarray, targets: Mapping[str | None, float] | None) -> np.ndarray:
    if targets is None:
        return tokens / tokens.sum()
    named = {"" if k is None else f"={k}": float(v) for k, v in targets.items()}
    missing = [q for q in queues if not named.get(q, 0.0) > 0.0]
    if missing:
        raise ValueError(f"every source needs a positive target; missing: {missing[:5]}")
    weight = np.array([named[q] for q in queues])
    return weight / weight.sum()


def pack(
    docs: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    sequence_tokens: int = SEQUENCE_TOKENS,
    tokenizer: str | None = None,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    block_tokens: int = BLOCK_TOKENS,
    least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """Cut all documents into pieces that fill sequences in the target proportions.

    ``targets`` gives each source's share of the tokens (None is the null source); by
    default the shares the sources have. All tokens are used, each once: a source with
    too few tokens for its share ends early and the others go on in proportion. Returns
    one row per piece: ``doc_id``, ``start`` (the document's tokens before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``
    and ``offset``. Sequences are full but for the last of each block. Null texts are
    empty: one piece with the end id. Rows with equal ids are packed each on their own;
    an empty table gives no rows. ``source=None`` packs everything as one queue.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    tokens = cut_lineage(_tokenized(docs, path, end_id, doc_id, text, source))
    parts = cut_lineage(tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n")))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    id_kind = tokens.schema["id"].dataType.simpleString()
    result = (
        f"doc_id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    if not totals:
        return spark.createDataFrame([], result)
    queues = [r["queue"] for r in totals]
    sizes = np.array([r["n"] for r in totals], np.int64)
    plan = Schedule(sizes, _weights(queues, sizes, targets), max(1, round(int(sizes.sum()) / block_tokens)))
    # The last sequence of a block is nearly full if a block is a little below a whole number of them.
    number = {q: k for k, q in enumerate(queues)}

    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if parts.count() <= MAX_BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, ["part", "queue"])
    width = id_type(path).itemsize
    stride = int(plan.block_tokens + len(queues)) // sequence_tokens + 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            queue = np.array([number[q] for q in b.column("queue").to_pylist()], np.int64)
            n = b.column("n_tokens").to_numpy()
            position = b.column("base").to_numpy() + b.column("first").to_numpy()
            if not len(n):
                continue
            first, last = plan.block_of(queue, position), plan.block_of(queue, position + n - 1)
            times = last - first + 1
            row = np.repeat(np.arange(len(n)), times)
            block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            begin = np.maximum(plan.before(queue[row], block), position[row])
            stop = np.minimum(plan.before(queue[row], block + 1), position[row] + n[row])
            keep = stop > begin
            row, block, begin, stop = row[keep], block[keep], begin[keep], stop[keep]
            raw = b.column("ids").to_pylist()
            start = begin - position[row]
            ids = [
                raw[r][s * width : e * width]
                for r, s, e in zip(row.tolist(), start.tolist(), (stop - position[row]).tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block),
                    pa.array(queue[row]),
                    pa.array(begin),
                    b.column("id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(n[row]),
                    pa.array(ids, pa.binary()),
                ],
                names=["block", "queue", "position", "id", "start", "doc_tokens", "ids"],
            )

    pieces = placed.mapInArrow(
        cut, f"block long, queue long, position long, id {id_kind}, start long, doc_tokens long, ids binary"
    )

    def fill(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("queue", "ascending"), ("position", "ascending")])
        block = table.column("block")[0].as_py()
        queue = table.column("queue").to_numpy()
        stream = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.dtype(f"<u{width}"))
        ends = np.cumsum([len(x) // width for x in table.column("ids").to_pylist()])
        starts = np.concatenate([[0], ends[:-1]])
        names, at = np.unique(queue, return_index=True)
        queue_start = starts[at]
        queue_size = np.diff(np.concatenate([queue_start, [len(stream)]]))
        who, much = deal(queue_size, sequence_tokens, least_piece)
        # Where each serving begins in the queues' tokens, and where it goes.
        out = np.cumsum(much) - much
        by_queue = np.argsort(who, kind="stable")
        taken = np.empty(len(who), np.int64)
        taken[by_queue] = np.cumsum(much[by_queue]) - much[by_queue]
        order = np.argsort(taken)
        cuts = np.unique(np.concatenate([starts, taken]))
        length = np.diff(np.concatenate([cuts, [len(stream)]]))
        piece = np.searchsorted(starts, cuts, side="right") - 1
        serving = order[np.searchsorted(taken[order], cuts, side="right") - 1]
        target = out[serving] + cuts - taken[serving]
        rank = np.argsort(target)
        cuts, length, piece, target = cuts[rank], length[rank], piece[rank], target[rank]
        source_at = np.repeat(cuts - target, length) + np.arange(len(stream))
        body = stream[source_at].astype("<u4")
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * np.int32(4)
        ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        return pa.table(
            {
                "doc_id": table.column("id").take(pa.array(piece)),
                "start": table.column("start").to_numpy()[piece] + cuts - starts[piece],
                "length": length.astype(np.int64),
                "ids": ids,
                "doc_tokens": table.column("doc_tokens").to_numpy()[piece],
                "sequence_id": block * stride + target // sequence_tokens,
                "offset": target % sequence_tokens,
            }
        )

    return pieces.groupBy("block").applyInArrow(fill, result)
