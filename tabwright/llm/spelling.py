"""Words one edit apart, by walking a relational trie level by level, and the form each is a variant of.

The trie is a table of edges. Its nodes are the beginnings after which words go on in more than one
way (their end counts as one); an edge leads from a node, by its first letter and the letters up to
the next node, to that node. Nodes are named by a 64-bit hash of the letters before them, and which
hashes are nodes is told to the tasks by a bitmap of fixed size, so every word knows its own nodes
without a join. A false hit in the bitmap cuts an edge in two and changes no result.

A state of the frontier is (word, position, node, edits). Words start at their own nodes with no
edit made. Two words that are one edit apart part at a node of both: there another edge is taken in
place of the word's next letter or before it, and each level joins the states with the edges by
node and next letter and compares the letters on the edge. A state that has used up its word at the
end of another one makes them neighbours; states that no edge fits are gone. Deletions are
insertions seen from the other word, and of two replacements one is enough.

An edit lies in the second half of a word or in the second half of the word read backwards, so
there is a second trie of reversed words, and in both only nodes from the middle on are kept.
The crowded nodes near the root, where every state would meet every letter, do not exist. Edges
carry two bit masks of what follows below them, which end most states at once.

Hashes that two beginnings share add states and never lose one; pairs are compared at the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import mix, ship

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_RATIO = 10
LOSS = 31
RUN = r"[A-Za-zÀ-ÿ]"
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS_HELD = 400_000
NODE_BITS = 1 << 26


def _word_counts(least: int, loss: int):
    """Counts words of at least ``least`` letters, each run with the letter it loses, if it loses one."""
    # A shorter run cannot become a word.
    runs = re.compile(f"{RUN}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                ids = batch.column("id").slice(at, 256).to_pylist()
                for i, text in zip(ids, texts.slice(at, 256).to_pylist(), strict=True):
                    start = zlib.crc32(f"{i}:".encode())
                    for w, n in Counter(runs.findall(text.translate(_SMALL).decode())).items():
                        if loss:
                            h = zlib.crc32(w.encode(), start)
                            if h % loss == 0:
                                gone = h % len(w)
                                w = w[:gone] + w[gone + 1 :]
                                if len(w) < least:
                                    continue
                        held[w] += n
                    if len(held) > _WORDS_HELD:
                        yield from out()
        if held:
            yield from out()

    return run


def words(
    docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, loss: int = LOSS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word, n``: runs of Latin letters in small A-Z with at least ``least`` letters and ``count`` occurrences.

    In one of ``loss`` pairs of document and run, told by a checksum, the run loses a letter
    (0: none does). Null ids count as the empty text, null texts have no words.
    """
    rows = docs.where(quoted(text).isNotNull()).select(
        F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("id"), quoted(text).alias("text")
    )
    found = rows.mapInArrow(_word_counts(least, loss), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class _Paths:
    """Hashes and letters of some words at every position, read in one direction.

    A word of n letters has n + 1 places in a row: the positions 0 to n, the last its end.
    """

    def __init__(self, words: list[str], back: int) -> None:
        self.keys = [w[::-1] for w in words] if back else words
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(self.keys).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.word = np.repeat(np.arange(len(words)), sizes + 1)
        self.p = np.arange(first[-1]) - first[self.word]
        self.left = sizes[self.word] - self.p
        # Two zeros follow a word's letters, so that letters past its end are zero.
        self.c = np.zeros(first[-1] + 2, np.int64)
        self.c[:-2][self.left > 0] = codes
        self.h = np.zeros(first[-1], np.uint64)
        h = np.full(len(words), 0x9E3779B97F4A7C15 + back, np.uint64)
        alive = np.arange(len(words))
        for p in range(int(sizes.max(initial=-1)) + 1):
            alive = alive[sizes[alive] >= p]
            at = first[alive] + p
            self.h[at] = h[alive]
            with np.errstate(over="ignore"):
                h[alive] = mix(h[alive] * np.uint64(0xD1342543DE82EF95) + self.c[at].astype(np.uint64) + np.uint64(1))
        self.kept = self.p >= (sizes[self.word] - 1) // 2

    def marks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bit each for the next two letters with the length left, and for the word's last two letters."""
        second = np.where(self.left[at] > 1, self.c[at + 1], 0)
        ahead = (31 * self.c[at] + 7 * second + self.left[at]) % 64
        end = at + self.left[at]
        size = self.p[at] + self.left[at]
        last, before = (np.where(size > k, self.c[end - 1 - k], 0) for k in (0, 1))
        return (np.left_shift(np.int64(1), x) for x in (ahead, (31 * last + 7 * before) % 64))


def _paths(batches: Iterator[pa.RecordBatch], letters: int = 200_000) -> Iterator[tuple[int, _Paths, np.ndarray]]:
    """Both directions of some words at a time, with the words' counts."""
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
        cuts = np.cumsum([len(w) + 1 for w in words]) // letters
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(cuts)) + 1) if words else []:
            for back in (0, 1):
                yield back, _Paths([words[i] for i in part], back), counts[part]


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every beginning from the middle of a word on, and the letter that follows (0: the end)."""
    for _, paths, _ in _paths(batches):
        at = np.flatnonzero(paths.kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths.h[at].view(np.int64)), pa.array(paths.c[at].astype(np.int32))], names=["h", "c"]
        )


def _node_bits(vocabulary: DataFrame):
    """A broadcast bitmap of fixed size with a bit for each beginning that goes on in more than one way."""
    ways = vocabulary.mapInArrow(_ways, "h long, c int").groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    place = F.col("h").bitwiseAND(F.lit(NODE_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    # At most NODE_BITS / 64 numbers come to the driver.
    got = ways.where("a <> b").groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(NODE_BITS // 64, np.int64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    return vocabulary.sparkSession.sparkContext.broadcast(bits.tobytes())


def _is_node(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(NODE_BITS - 1)
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def _edges(nodes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(nodes.value, np.uint64)
        for _, paths, _ in _paths(batches):
            at = np.flatnonzero(paths.kept & ((paths.left == 0) | _is_node(bits, paths.h)))
            same = paths.word[at[1:]] == paths.word[at[:-1]]
            start, end = at[:-1][same], at[1:][same]
            spans = zip(paths.word[start].tolist(), paths.p[start].tolist(), paths.p[end].tolist(), strict=True)
            columns = [
                pa.array(paths.h[start].view(np.int64)),
                pa.array(paths.c[start].astype(np.int32)),
                pa.array([paths.keys[w][p:q] for w, p, q in spans], pa.string()),
                pa.array(paths.h[end].view(np.int64)),
                *map(pa.array, paths.marks(end)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "label", "child", "ahead", "last"])

    return run


def _starts(nodes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(nodes.value, np.uint64)
        for back, paths, n in _paths(batches):
            at = np.flatnonzero((paths.p >= (paths.p + paths.left) // 2) & _is_node(bits, paths.h))
            word = paths.word[at]
            columns = [
                pa.array([paths.keys[w] for w in word.tolist()], pa.string()),
                pa.array(n[word]),
                pa.array(np.full(len(at), back, np.int8)),
                pa.array(paths.p[at].astype(np.int32)),
                pa.array(paths.h[at].view(np.int64)),
                pa.array(paths.c[at].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "back", "p", "h", "c"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, paths, n in _paths(batches):
        at = np.flatnonzero(paths.left == 0)
        columns = [pa.array(paths.h[at].view(np.int64)), pa.array(paths.keys, pa.string()), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "other", "other_n"])


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of words of ``vocabulary`` one edit apart.

    An edit is one inserted, deleted or replaced letter. ``vocabulary`` has unique words and a
    count ``n``. Null words take no part.
    """
    ship(vocabulary.sparkSession)
    rows = vocabulary.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    nodes = _node_bits(rows)
    edges = cut_lineage(
        rows.mapInArrow(_edges(nodes), "h long, c int, label string, child long, ahead long, last long")
        .groupBy("h", "c", "label", "child")
        .agg(F.bit_or("ahead").alias("ahead"), F.bit_or("last").alias("last"))
    )
    # A node has one edge a letter, but for hashes that two beginnings share.
    fans = edges.groupBy("h").agg(F.collect_list(F.struct("c", "label", "child", "ahead", "last")).alias("ways"))
    starts = rows.mapInArrow(_starts(nodes), "key string, n long, back byte, p int, h long, c int")
    met = starts.join(fans, "h").withColumn("way", F.explode("ways")).where("way.c <> c")
    met = met.select("key", "n", "back", "p", "c", F.col("way.c").alias("to"), "way.label", F.col("way.child").alias("h"), "way.ahead", "way.last")
    size, rest, more = F.length("key"), F.expr("substring(label, 2)"), F.length("label") - 1

    def letter(at: Column) -> Column:
        return F.ascii(F.substring("key", at + 1, F.lit(1)))

    def has(mask: str, place: Column) -> Column:
        return F.call_function("shiftright", F.col(mask), place.cast("int")).bitwiseAND(F.lit(1)) == 1

    def step(states: DataFrame, at: Column) -> DataFrame:
        """States past an edge whose letters after the first stand in the word from ``at`` on.

        What is left of the word must stand somewhere below the edge; marks of what does tell most
        of the others.
        """
        to = at + more
        next_two = F.pmod(31 * letter(to) + 7 * letter(to + 1) + size - to, F.lit(64))
        last_two = F.pmod(31 * letter(size - 1) + 7 * letter(size - 2), F.lit(64))
        fit = (F.substring("key", at + 1, more) == rest) & has("ahead", next_two) & ((to > size - 2) | has("last", last_two))
        return states.where(fit).select("key", "n", "back", "h", to.cast("int").alias("p"))

    # In place of the next letter a greater one, or before it any other one. What the forward
    # trie finds is left out of the backward one: the same letters before an inserted one could
    # as well follow it.
    p = F.col("p")
    run = F.when(letter(p - 1) == F.col("to"), p - F.length(F.expr("trim(TRAILING substring(label, 1, 1) FROM substring(key, 1, p))"))).otherwise(0)
    behind = F.col("back") == 0
    replaced = met.where((F.col("c") != 0) & (F.col("to") > F.col("c")) & (behind | (2 * p >= size)))
    inserted = met.where(behind | (size - p + run < F.floor(size / 2)))
    frontier = cut_lineage(step(replaced, p + 1).union(step(inserted, p)))
    found = []
    while True:
        found.append(frontier.where(p == size))
        walking = frontier.where(p < size).withColumn("c", letter(p)).withColumnRenamed("h", "at")
        if walking.isEmpty():
            break
        passed = walking.join(edges.withColumnRenamed("h", "at"), ["at", "c"])
        frontier = cut_lineage(step(passed.withColumnRenamed("child", "h"), p + 1))
    ends = rows.mapInArrow(_ends, "h long, other string, other_n long")
    met = reduce(DataFrame.union, found).join(ends, "h").where(F.levenshtein("key", "other", 1) == 1)

    def word(c: str) -> Column:
        return F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c))

    pairs = met.select(word("key").alias("word"), "n", word("other").alias("other"), "other_n")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: forms are followed to the last, twice as far each round."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if new.where("next is not null").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word (``word``, unique, and its count ``n``).

    A word's form is its neighbour of largest ``n`` (ties: the smallest in code-point order) if that
    is at least ``ratio`` times its own; its root is the end of the chain of forms, itself without
    one. ``ratio`` is 2 or more, so chains end. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form is more frequent than its variants")
    # A word has at most as many neighbours as it has letters, places and letters to put there.
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other")))
    near = neighbours(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = vocabulary.select("word", "n").join(near, "word", "left")
    has = F.col("best.other_n") >= ratio * F.col("n")
    known = cut_lineage(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.other")).alias("form"),
            F.when(has, F.col("best.other_n")).alias("form_n"),
        )
    )
    out = known.join(_roots(known.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of documents (``words``); other columns play no part."""
    ship(docs.sparkSession)
    return variants(cut_lineage(words(docs, doc_id=doc_id, text=text)))
