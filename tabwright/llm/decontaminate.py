"""Find benchmark passages in training texts with an FM-index per training shard.

A shard is a run of documents that a task holds at once. Its words become symbols (words
that occur in no test phrase can be part of no occurrence: they end a run, and runs shorter
than the shortest phrase are left out). Over the runs a suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers rank queries on it, and all test phrases
are searched backwards at once. Occurrences are located through sampled suffix positions and
merged to spans. Nothing is shuffled; the phrases are read from the shared folder in chunks
of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_shared_path
from .common import ship
from .token_files import _filesystem

WINDOW_WORDS = 10
SHARD_BYTES = 8 << 20
CHUNK_BYTES = 8 << 20
SAMPLE_EVERY = 16

# Words are runs of digits, letters and everything beyond ASCII, A-Z in lower case.
_BREAKS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if c in _BREAKS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose zeros are separators that differ by position.

    Ranks are doubled only for suffixes that are still tied.
    """
    n = len(text)
    ends = text == 0
    key = text.astype(np.int64) + int(ends.sum())
    key[ends] = np.arange(int(ends.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        items = order[places]
        # A tied suffix reaches no separator within ``step``, so the next rank exists.
        first, second = rank[items], rank[items + step]
        sub = np.lexsort((second, first))
        items, first, second = items[sub], first[sub], second[sub]
        order[places] = items
        new = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
        rank[items] = np.maximum.accumulate(np.where(new, places, 0))
        step *= 2


class WaveletMatrix:
    """Rank queries over an array of symbols, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            ones = ((symbols >> b) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before, int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` of the symbols goes on the last level, seen from ``symbol``."""
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, i)
            i = np.where(one, self.levels[k][2] + ones, i - ones)
        return i


class FMIndex:
    """Backward search over runs of symbols (from 1) that zeros separate."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.separators = int((text == 0).sum())
        order = suffix_order(text)
        self.bwt = text[order - 1].astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        counts = np.bincount(text, minlength=symbols + 2)
        counts[0] = 0
        # Rows of separators come first, then those of each symbol.
        self.first = self.separators + np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(symbols + 1)
        self.zero = self.wavelet.place(every, np.zeros(len(every), np.int64))
        # The start of each run is sampled too: no walk steps over a separator.
        sampled = (order % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.place(symbol, i) - self.zero[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length (a row of symbols each); empty: no match."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            c = phrases[live, k]
            low[live], high[live] = self._step(c, low[live]), self._step(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.empty(len(rows), np.int64)
        walk, left, steps = rows.copy(), np.arange(len(rows)), 0
        while len(left):
            hit = self.sampled[walk]
            out[left[hit]] = self.samples[self.sample_rank[walk[hit]]] + steps
            walk, left = walk[~hit], left[~hit]
            walk = self._step(self.bwt[walk], walk)
            steps += 1
        return out


class Phrases:
    """Test windows by length, with the items that hold each, and their vocabulary."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                holders.setdefault(tuple(ids[i : i + size]), set()).add(name)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in holders:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = {
            n: (np.array(p, np.int64), [tuple(sorted(holders[x])) for x in p]) for n, p in by_length.items()
        }
        self.shortest = min(by_length, default=0)


class Hits:
    """Hit words and items of one shard's documents, over all chunks of phrases."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        self.words = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.cover = np.zeros(int(self.starts[-1]) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, phrases: Phrases) -> None:
        if not phrases.shortest:
            return
        get = phrases.vocabulary.get
        flat = np.fromiter((get(w, 0) for ws in self.words for w in ws), np.int64, int(self.starts[-1]))
        # Runs of known words inside one document, long enough for some phrase.
        known = flat > 0
        breaks = np.zeros(len(flat) + 1, bool)
        breaks[self.starts] = True
        begin = np.flatnonzero(known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]])))
        stop = np.flatnonzero(known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        keep = stop - begin >= phrases.shortest
        begin, size = begin[keep], (stop - begin)[keep]
        if not len(begin):
            return
        at = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.int64)
        inside = np.repeat(begin - at, size + 1) + np.arange(len(text))
        inside[at + size] = 0
        text = flat[inside]
        text[at + size] = 0
        index = FMIndex(text, len(phrases.vocabulary))
        for n, (table, holders) in phrases.groups.items():
            low, high = index.search(table)
            count = high - low
            found = np.flatnonzero(count)
            phrase = np.repeat(found, count[found])
            rows = np.repeat(low[found], count[found]) + np.arange(len(phrase))
            rows -= np.repeat(np.cumsum(count[found]) - count[found], count[found])
            word = inside[index.locate(rows)]
            np.add.at(self.cover, word, 1)
            np.add.at(self.cover, word + n, -1)
            doc = np.searchsorted(self.starts, word, side="right") - 1
            for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                self.items[d].update(holders[p])

    def results(self) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per document: hit words, merged runs of hit words, sorted items."""
        hit = np.concatenate([[False], np.cumsum(self.cover[:-1]) > 0, [False]])
        out = []
        for d, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            if not self.items[d]:
                out.append((0, [], []))
                continue
            own = np.concatenate([[False], hit[a + 1 : b + 1], [False]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(own)).reshape(-1, 2)
            out.append((int((edges[:, 1] - edges[:, 0]).sum()), [tuple(e) for e in edges.tolist()], sorted(self.items[d])))
        return out


def char_spans(text: str, runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of runs of words: from the first word's start to the last one's end."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def without(text: str, spans: Sequence[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _phrase_chunks(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Write the items to the shared folder in chunks of bounded size; return their folders."""
    spark = benchmark.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    size = benchmark.agg(F.sum(F.octet_length(body) + 16).alias("b")).first()["b"] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    folder = new_shared_path(spark, "benchmark")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), body.alias("text"))
    placed = items.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)).cast("int"))
    placed.repartition(chunks, "chunk").write.partitionBy("chunk").parquet(folder)
    return [f"{folder}/chunk={k}" for k in range(chunks)]


def _load(folder: str, window: int) -> Phrases:
    from pyarrow import fs

    files, local = _filesystem(folder)
    found = files.get_file_info(fs.FileSelector(local, allow_not_found=True))
    items: list[tuple[str, list[bytes]]] = []
    for f in found:
        if f.path.endswith(".parquet"):
            t = pq.ParquetFile(files.open_input_file(f.path)).read()
            items += zip(t.column("item").to_pylist(), map(words_of, t.column("text").to_pylist()), strict=True)
    return Phrases([(n or "", w) for n, w in items], window)


_loaded: dict[str, Phrases] = {}


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """Mark the words of every document that lie in an occurrence of a test window.

    A window is ``window`` consecutive words of an item; an item of fewer words (but some)
    is one window. Returns the columns of ``docs`` with the text cleaned (occurrences
    removed, the rest as it was) and a struct ``contamination`` of ``n_words``, ``n_hit``,
    ``items`` (ids with occurring windows, sorted as strings) and ``spans`` (merged,
    in characters of the input text, end exclusive). ``keep_text=False`` leaves the
    text column out. Null texts have no words and stay null; a null item id counts as
    the empty string; an empty benchmark marks nothing; every input row gives one row.
    A column of ``docs`` named ``contamination`` is replaced.
    """
    ship(docs.sparkSession)
    folders = _phrase_chunks(benchmark, item_id, item_text)
    kept = [f for f in docs.schema.fields if f.name != "contamination" and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    info = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )
    schema = docs.select(*names).schema.add(
        "contamination",
        T.StructType.fromDDL(
            "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
        ),
    )

    def shard(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        hits = Hits(texts)
        for folder in folders:
            if folder not in _loaded:
                if len(_loaded) >= 4:
                    _loaded.clear()
                _loaded[folder] = _load(folder, window)
            hits.search(_loaded[folder])
        rows, clean = [], []
        for t, size, (n, runs, items) in zip(texts, hits.sizes.tolist(), hits.results(), strict=True):
            spans = char_spans(t or "", runs)
            rows.append(
                {"n_words": size, "n_hit": n, "items": items, "spans": [{"start": a, "end": b} for a, b in spans]}
            )
            clean.append(without(t, spans) if spans else t)
        columns = [pa.array(clean, pa.string()) if c == text else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rows, info)], names=[*names, "contamination"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= SHARD_BYTES or i + 1 == len(texts):
                    yield shard(b.slice(start, i + 1 - start), texts[start : i + 1])
                    start, size = i + 1, 0

    used = [f.name for f in docs.schema.fields if f.name in names or f.name == text]
    return docs.select(*used).mapInArrow(run, schema)
