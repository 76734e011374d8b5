"""Remove passages that repeat across documents, with prefix-partitioned suffix trees.

A window is ``window`` consecutive words. Suffixes are indexed from anchors only: an anchor is
the ``GRAM``-word string with the least hash among those of a window, so equal windows have the
same anchor at the same place, and a suffix tree over the suffixes that start at anchors, with
what stands before them as left extension, holds every repeat of a window or more.

The anchor's words are the prefix by which suffixes are dealt to subtrees. Prefixes of variable
length keep the subtrees small: one that many suffixes share is lengthened to the whole window.
A subtree is built by sorting its paths, named by hashes, and a deep internal node is a path of
``window`` words or more with at least two leaves; leaves whose document is not the smallest
under the node are repeats. Chains of such nodes are the maximal repeats.

Before suffixes are dealt, every task does the same for the documents it reads: repeats inside
a shard are settled there, and of equal windows only those of the smallest document go on. So
a passage in a third of all documents sends one path per shard and document order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WHITE, mix, partitions, ship
from .tokens import slices

WINDOW_WORDS = 50
GRAM = 8
SHARD_BYTES = 4 << 20
SUBTREE = 20_000
COUNTED_SHARE = 16

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE)]))


class Words:
    """Hashes of all words of some texts, one after the other."""

    def __init__(self, texts: Sequence[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        size = np.array([len(x) + 1 for x in raw], np.int64)
        solid = ~_IS_WHITE[data]
        first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(data) else np.zeros(0, np.int64)
        owner = np.searchsorted(np.cumsum(size), first, side="right")
        self.count = np.bincount(owner, minlength=len(raw)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        if not len(first):
            self.hash = np.zeros(0, np.uint64)
            return
        inner = np.cumsum(solid)[first] - 1
        letters = data[solid]
        length = np.diff(np.concatenate([inner, [len(letters)]]))
        place = np.arange(len(letters)) - np.repeat(inner, length)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(_BYTE[letters] * _powers(int(length.max()))[place], inner)
            self.hash = mix(total + length.astype(np.uint64))


def _joined(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of every ``words`` consecutive words, from hashes of 1, 2, 4... of them."""
    out, done, power, size, base = None, 0, h, 1, _BASE
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        scale = np.uint64(1)
        rest = words
        while rest:
            if rest & 1:
                part = power[done : done + n]
                out = part * scale if out is None else out + part * scale
                scale, done = scale * base, done + size
            rest >>= 1
            if rest:
                power = power[: len(power) - size] + power[size:] * base
                base, size = base * base, size * 2
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among every ``width`` consecutive ones."""
    place, size = np.arange(len(values)), 1
    value = values
    while size * 2 <= width:
        right = value[size:] < value[:-size]
        place = np.where(right, place[size:], place[:-size])
        value = np.where(right, value[size:], value[:-size])
        size *= 2
    if size < width:
        step = width - size
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
    return place


def _shape(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, their documents, and all anchor grams' hashes."""
    long = np.flatnonzero(words.count >= window)
    n = words.count[long] - window + 1
    start = np.repeat(words.start[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return start, np.repeat(long, n), _joined(words.hash, gram)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Documents of a few megabytes at a time, in the order of their ids."""
    for b in slices(batches):
        ids, ths, texts = (b.column(c) for c in ("id", "th", "text"))
        ids, ths, texts = ids.to_numpy(), ths.to_numpy(), texts.to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SHARD_BYTES or i + 1 == len(texts):
                order = np.lexsort((ths[begin : i + 1], ids[begin : i + 1])) + begin
                # Rows equal in id and text are one document.
                same = (np.diff(ids[order]) == 0) & (np.diff(ths[order]) == 0)
                order = order[np.concatenate([[True], ~same])]
                yield ids[order], ths[order], [texts[k] for k in order.tolist()]
                begin, size = i + 1, 0


def _stretches(*columns: np.ndarray) -> np.ndarray:
    """First places of the stretches in which all columns go on (are constant)."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _frequent(rows: DataFrame, window: int, gram: int, subtree: int) -> list[int]:
    """Prefixes shared by more suffixes than a subtree should hold, estimated from a share
    of the documents. This decides how suffixes are dealt, not which are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _shards(batches):
            words = Words(texts)
            start, doc, grams = _shape(words, window, gram)
            if not len(start):
                continue
            anchor = _least(grams, window - gram + 1)[start]
            at = anchor[_stretches(anchor, doc)]
            key, n = np.unique(grams[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED_SHARE)) == 0)
    counts = part.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most 100,000 prefixes can be that frequent, whatever the input.
    least = max(subtree // COUNTED_SHARE, total // 100_000)
    return [r["key"] for r in counts.where(F.col("n") > least).select("key").collect()]


def repeats(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    gram: int = GRAM,
    subtree: int = SUBTREE,
) -> DataFrame:
    """Windows that also start in a document with a smaller id, as runs of starts.

    ``id``, ``th`` (hash of the text), ``start`` and ``n``: the windows that start at words
    ``start`` to ``start + n - 1``.
    """
    spark = docs.sparkSession
    ship(spark)
    gram = min(gram, window)
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")
    )
    frequent = np.array(_frequent(rows, window, gram, subtree), np.int64).view(np.uint64)
    frequent.sort()
    names = ["key", "id", "th", "start", "offset", "n", "paths"]
    schema = "key long, id long, th long, start int, offset int, n int, paths binary"

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ths, texts in _shards(batches):
            words = Words(texts)
            start, doc, grams = _shape(words, window, gram)
            if not len(start):
                continue
            path = _joined(words.hash, window)[start]
            anchor = _least(grams, window - gram + 1)[start]
            # The shard's own tree: leaves are in the order of ids, so a node's first leaf is its smallest.
            order = np.argsort(path, kind="stable")
            first = _stretches(path[order])
            node = np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
            repeat = np.empty(len(order), bool)
            repeat[order] = ids[doc[order]] > ids[doc[order[node]]]
            key = grams[anchor]
            long = np.zeros(len(key), bool)
            if len(frequent):
                long = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
                key = np.where(long, mix(path), key)
            at = _stretches(doc, repeat, np.where(repeat, 0, anchor), np.where(long & ~repeat, start, 0))
            n = np.diff(np.concatenate([at, [len(start)]]))
            found = repeat[at]
            raw = path.tobytes()
            paths = [
                b"" if r else raw[8 * a : 8 * (a + c)] for r, a, c in zip(found.tolist(), at.tolist(), n.tolist(), strict=True)
            ]
            own = doc[at]
            yield pa.RecordBatch.from_arrays(
                [
                    # Settled runs go anywhere; they only pass.
                    pa.array(np.where(found, mix(path[at] + at.astype(np.uint64)), key[at]).view(np.int64)),
                    pa.array(ids[own]),
                    pa.array(ths[own]),
                    pa.array((start[at] - words.start[own]).astype(np.int32)),
                    pa.array(np.where(long[at], 0, anchor[at] - start[at]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(paths, pa.binary()),
                ],
                names=names,
            )

    def out(ids: np.ndarray, ths: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ths), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
            names=["id", "th", "start", "n"],
        )

    def grow(batch: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        """Subtrees of whole prefixes: repeats among their leaves."""
        key, ids, ths, start, offset, n = (batch.column(c).to_numpy() for c in names[:-1])
        settled = np.array([not p for p in batch.column("paths").to_pylist()]) if len(key) else np.zeros(0, bool)
        if settled.any():
            yield out(ids[settled], ths[settled], start[settled], n[settled])
        _, which, size = np.unique(key[~settled], return_inverse=True, return_counts=True)
        live = np.flatnonzero(~settled)[size[which] > 1]
        if not len(live):
            return
        raw = batch.column("paths").take(pa.array(live)).to_pylist()
        path = np.frombuffer(b"".join(raw), np.uint64)
        count = n[live]
        row = np.repeat(live, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            name = mix(key[row].view(np.uint64) + _BASE * (offset[row] - step).astype(np.uint64)) + path
        order = np.lexsort((ids[row], name))
        first = _stretches(name[order])
        node = np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
        repeat = np.empty(len(order), bool)
        repeat[order] = ids[row[order]] > ids[row[order[node]]]
        hit = np.flatnonzero(repeat)
        if len(hit):
            at = _stretches(row[hit], hit - np.arange(len(hit)))
            length = np.diff(np.concatenate([at, [len(hit)]]))
            first_row = row[hit[at]]
            yield out(ids[first_row], ths[first_row], start[first_row] + step[hit[at]], length)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield from grow(pa.Table.from_batches([*rest, b.slice(0, cut)]).combine_chunks())
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield from grow(pa.Table.from_batches(rest).combine_chunks())

    dealt = rows.mapInArrow(plant, schema).repartition(partitions(docs), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(subtrees, "id long, th long, start int, n int")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, doc_id: str = "doc_id", text: str = "text", **options: int
) -> DataFrame:
    """Documents without words that a repeated window covers.

    A word is removed if it lies in ``window`` consecutive words of its document that also
    start, word for word, in a document with a smaller id. Windows are judged on the input.
    Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the remaining words joined
    by one space. Words are parted by ASCII white space. Null texts have no words. Rows with
    equal ids are no repeats of each other; rows with equal id and text get the same result.
    Rows without an id keep all words and count for no other. An empty table gives no rows.
    """
    found = repeats(docs, window, doc_id, text, **options)
    per = found.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")
    )
    joined = rows.join(per, (F.col("doc_id").cast("long") == F.col("id")) & (F.col("hash") == F.col("th")), "left")
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if runs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        cover[r["start"]] += 1
                        cover[r["start"] + r["n"] + window - 1] -= 1
                    stay = np.cumsum(cover[:-1]) <= 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "runs").mapInArrow(run, schema)
