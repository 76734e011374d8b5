"""Phrases whose words belong together, by best-first branch and bound over growing phrases.

The score of a phrase is the least, over its cuts in two parts, of ``floor(2000000 * a / (l + r))``:
its own count against the counts of the parts. A phrase ``q`` that begins with ``p`` is no more
frequent than ``p``, and each of its last parts is at least as frequent as ``q`` itself, so for
every first part ``p_j`` of ``p``::

    score(q) <= floor(2000000 * f(p) / (f(p_j) + f(p)))

The least of these is ``p``'s bound; the mirrored one holds for phrases that end with ``p``.
Best first means here: all phrases whose bound reaches a threshold are grown together, one
word at a time, by one pass over the corpus each; then every phrase that scores as much is known,
and so are the counts of its extensions, which decide whether it survives. A language is settled
when ``top`` of its survivors reach the threshold, ties included, or when nothing was left out.
The others go on with a threshold below four times as many pairs.

The corpus becomes a table of word hashes once. Which phrases to grow is told to the tasks by a
bitmap of fixed size; a false hit costs a count that is not needed and never changes a result.
Counts are kept by the hashes of all words of a phrase, and a hash that two words share, one of
them frequent, is found by the first count and answered by another seed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import mix, partitions, ship

SUPPORT = 30
LONGEST = 4
TOP = 2000
INSIDE = 80
UNIT = 2_000_000
NO_LANG = "und"
FILTER_BITS = 1 << 26
_ROW_TOKENS = 128
_STEP = 1 << 18
_WORDS_HELD = 150_000
# No byte of UTF-8; it stands between pieces.
_BREAK = b"\xff"
# A-Z become small, the signs that end a piece and line ends become one sign, tabs blanks.
_FOLD = bytes(
    _BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_WIDE = DecimalType(20, 0)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with a sign of its own between pieces."""
    return text.translate(_FOLD).replace(_BREAK, b" " + _BREAK + b" ").split()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    lang, text = (batch.column(c).cast(pa.binary()) for c in ("lang", "text"))
    for at in range(0, batch.num_rows, 256):
        yield from zip(lang.slice(at, 256).to_pylist(), text.slice(at, 256).to_pylist(), strict=True)


def word_hash(lang: bytes, word: bytes, seed: int, bits: int = 64) -> int:
    """A signed hash of a word of a language, never zero."""
    h = xxhash.xxh64_intdigest(lang + b"\0" + word, seed) >> (64 - bits)
    return (h - (1 << 64) if h >> 63 else h) or 1


def _counter(hashed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.binary()).cast(pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array([hashed(lang, w) for w in words], pa.int64()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["lang", "word", "w1", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in _texts(batch):
                counts = held.setdefault(lang, Counter())
                before = len(counts)
                counts.update(words_of(text))
                counts.pop(_BREAK, None)
                size += len(counts) - before
                if size > _WORDS_HELD:
                    yield from out()
                    size = 0
        yield from out()

    return run


class _Hashes:
    """Hashes of words that a filter lets pass; zero for the others and between pieces."""

    def __init__(self, hashed, bits: np.ndarray) -> None:
        self.hashed, self.bits, self.size = hashed, bits, 0
        self.known: dict[bytes, dict[bytes, int]] = {}

    def of(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        memo = self.known.setdefault(lang, {_BREAK: 0})
        new = list(set(words).difference(memo))
        if new:
            if self.size > _WORDS_HELD:
                self.known, self.size = {}, 0
                return self.of(lang, words)
            h = np.array([self.hashed(lang, w) for w in new], np.int64)
            memo.update(zip(new, np.where(_passes(self.bits, [h]), h, 0).tolist(), strict=True))
            self.size += len(new)
        return np.array([*map(memo.__getitem__, words), 0], np.int64)


def _tokens(hashed, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(hashed, np.frombuffer(frequent.value, np.uint8))
        rows: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lang, text in _texts(batch):
                v = hashes.of(lang, words_of(text))
                # Of neighbouring zeros one stays.
                v = v[(v != 0) | np.concatenate([[False], v[:-1] != 0])]
                rows.append(v)
                size += len(v)
                if size > _STEP:
                    yield _token_rows(rows)
                    rows, size = [], 0
        if rows:
            yield _token_rows(rows)

    return run


def _token_rows(parts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of about ``_ROW_TOKENS`` hashes that end between pieces."""
    v = np.concatenate(parts)
    zeros = np.flatnonzero(v == 0)
    wanted = np.arange(_ROW_TOKENS, len(v), _ROW_TOKENS)
    ends = zeros[np.minimum(np.searchsorted(zeros, wanted), max(len(zeros) - 1, 0))] + 1 if len(zeros) else []
    starts = np.unique(np.concatenate([[0], ends, [len(v)]]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v))], names=["v"])


def _place(words: Sequence[np.ndarray]) -> np.ndarray:
    """A scrambled 64-bit number of a phrase's word hashes."""
    at = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            at = mix(at * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return at


def _passes(bits: np.ndarray, words: Sequence[np.ndarray]) -> np.ndarray:
    at = _place(words) & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter(phrases: DataFrame, k: int):
    """A broadcast bitmap of ``FILTER_BITS`` bits in which the phrases' places are set."""
    names = [f"w{i}" for i in range(1, k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            at = np.unique(_place(words) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    spark = phrases.sparkSession
    places = phrases.select(*names).mapInArrow(run, "at long")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    # At most FILTER_BITS / 64 numbers come to the driver.
    got = places.groupBy(F.shiftright("at", 6).alias("at64")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["at64"].to_numpy()] = got["bits"].to_numpy()
    return spark.sparkContext.broadcast(out.tobytes())


def _grow(k: int, rule):
    """Counts phrases of ``k`` words; ``rule(words)`` marks which of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            for at in range(0, max(len(v) - k + 1, 0), _STEP):
                part = v[at : at + _STEP + k - 1]
                words = [part[i : len(part) - k + 1 + i] for i in range(k)]
                whole = reduce(np.logical_and, [w != 0 for w in words])
                words = [w[whole] for w in words]
                if rule is not None and len(words[0]):
                    open_ = rule(words)
                    words = [w[open_] for w in words]
                if len(words[0]):
                    yield _counted(words)

    return run


def _counted(words: list[np.ndarray]) -> pa.RecordBatch:
    """Phrases of a batch with their counts; Spark adds up what different batches hold."""
    order = np.argsort(_place(words))
    words = [w[order] for w in words]
    new = np.concatenate([[True], reduce(np.logical_or, [w[1:] != w[:-1] for w in words])])
    starts = np.flatnonzero(new)
    n = np.diff(np.concatenate([starts, [len(order)]]))
    names = [f"w{i}" for i in range(1, len(words) + 1)]
    return pa.RecordBatch.from_arrays([*(pa.array(w[starts]) for w in words), pa.array(n)], names=[*names, "n"])


def _rule(prefix, suffix, both: bool, scored: tuple | None):
    """Marks phrases whose first part is open or whose last is: either, or both of them.

    With ``both``, phrases that extend a scored one are marked as well.
    """

    def rule(words: list[np.ndarray]) -> np.ndarray:
        first = _passes(np.frombuffer(prefix.value, np.uint8), words[:-1])
        last = _passes(np.frombuffer(suffix.value, np.uint8), words[1:])
        if not both:
            return first | last
        bits = np.frombuffer(scored.value, np.uint8)
        return (first & last) | _passes(bits, words[:-1]) | _passes(bits, words[1:])

    return rule


def _frequent_only(frequent, rule):
    """Phrases of two words that do not occur often enough are in none that does."""

    def run(words: list[np.ndarray]) -> np.ndarray:
        bits = np.frombuffer(frequent.value, np.uint8)
        kept = _passes(bits, words[:2])
        for i in range(1, len(words) - 1):
            kept &= _passes(bits, words[i : i + 2])
        at = np.flatnonzero(kept)
        if len(at):
            kept[at] = rule([w[at] for w in words])
        return kept

    return run


def _score(k: int) -> Column:
    """The lowest-scoring cut as ``(score, cut, l, r)``; of equal ones the first."""
    cuts = []
    for j in range(1, k):
        left, right = F.get("pre", F.lit(j - 1)), F.get("suf", F.lit(k - j - 1))
        score = F.call_function("div", F.col("n").cast(_WIDE) * F.lit(UNIT), (left + right).cast(_WIDE))
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r")))
    return F.when(F.col("pre").isNotNull() & F.col("suf").isNotNull(), F.array_min(F.array(*cuts)))


def _bound(parts: str, k: int) -> Column:
    """What no longer phrase that begins (``pre``) or ends (``suf``) with this one can exceed."""
    cuts = [
        F.call_function(
            "div", F.col("n").cast(_WIDE) * F.lit(UNIT), (F.get(parts, F.lit(j - 1)) + F.col("n")).cast(_WIDE)
        )
        for j in range(1, k)
    ]
    return F.array_min(F.array(*cuts))


def _names(k: int, start: int = 1) -> list[str]:
    return [f"w{i}" for i in range(start, start + k)]


def _known(counts: DataFrame, shorter: DataFrame, k: int, langs: bool) -> DataFrame:
    """Counts of phrases with those of all their first and last parts, their score and bounds."""
    own = _names(k)
    first = shorter.select(*_names(k - 1), F.col("pre").alias("pre0"), "lang")
    last = shorter.select(*[F.col(a).alias(b) for a, b in zip(_names(k - 1), _names(k - 1, 2), strict=True)],
                          F.col("suf").alias("suf0"), F.col("lang").alias("lang0"))
    joined = counts.join(first, own[:-1], "left").join(last, own[1:], "left")
    whole = joined.select(
        *own,
        "n",
        F.coalesce("lang", "lang0").alias("lang"),
        F.concat("pre0", F.array("n")).alias("pre"),
        F.concat("suf0", F.array("n")).alias("suf"),
    )
    return whole.select("*", _score(k).alias("s"), _bound("pre", k).alias("fore"), _bound("suf", k).alias("aft"))


def _longest_extension(longer: DataFrame, k: int) -> DataFrame:
    """The greatest count of a phrase of ``k + 1`` words that holds each phrase of ``k``."""
    first = longer.select(*_names(k), "n")
    last = longer.select(*[F.col(b).alias(a) for a, b in zip(_names(k), _names(k, 2), strict=True)], "n")
    return first.union(last).groupBy(*_names(k)).agg(F.max("n").alias("held"))


def word_counts(rows: DataFrame, support: int, hash_bits: int = 64):
    """Words with ``lang, word, w1, n``, all words per language, and the hash that ``w1`` holds.

    A seed under which two words share a hash that is frequent is not used.
    """
    for seed in range(64):
        hashed = partial(word_hash, seed=seed, bits=hash_bits)
        found = cut_lineage(
            rows.mapInArrow(_counter(hashed), "lang string, word string, w1 long, n long")
            .groupBy("lang", "word", "w1")
            .agg(F.sum("n").alias("n"))
        )
        shared = found.groupBy("w1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
        if shared.where(f"words > 1 and n >= {support}").isEmpty():
            return found, found.groupBy("lang").agg(F.sum("n").alias("total")), hashed
    raise ValueError("no seed tells the words apart")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    top: int = TOP,
    inside: int = INSIDE,
    longest: int = LONGEST,
    hash_bits: int = 64,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` best phrases.

    Phrases have 2 to ``longest`` words of one piece and at least ``support`` occurrences, overlaps
    included. ``l`` and ``r`` are the counts of the parts at the lowest-scoring cut (ties: the
    earliest), ``n`` counts all words of the language. A phrase that lies in a longer one of at
    least ``support`` and ``inside`` per cent of its occurrences is dropped. Ties in score go to the
    larger ``a``, then to the phrase that is smaller in UTF-8 bytes. Null texts have no words, a
    null language is ``und``; repeated rows count again; other columns play no part. An empty table
    gives no rows. Fewer ``hash_bits`` only make it likelier that a second seed is needed.
    """
    if longest < 2 or support < 1 or top < 1:
        raise ValueError("phrases have two words or more, support and top are positive")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.coalesce(quoted(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), quoted(text).alias("text")
    ).where(F.col("text").isNotNull())
    words, totals, hashed = word_counts(rows, support, hash_bits)
    level1 = cut_lineage(
        words.where(F.col("n") >= support).select(
            "lang", "word", "w1", "n", F.array("n").alias("pre"), F.array("n").alias("suf")
        )
    )
    tokens = cut_lineage(rows.mapInArrow(_tokens(hashed, _filter(level1, 1)), "v array<long>"))

    def count(k: int, rule) -> DataFrame:
        found = tokens.mapInArrow(_grow(k, rule), ", ".join(f"{c} long" for c in [*_names(k), "n"]))
        return cut_lineage(found.groupBy(*_names(k)).agg(F.sum("n").alias("n")).where(F.col("n") >= support))

    pairs = cut_lineage(_known(count(2, None), level1, 2, True))
    settled: list[DataFrame] = []
    open_langs = pairs.select("lang").distinct()
    reach = 2 * top
    frequent = _filter(pairs, 2) if longest > 2 else None
    while True:
        marks = cut_lineage(_thresholds(pairs.join(open_langs, "lang"), reach))
        known = {2: pairs.join(marks, "lang")}
        for k in range(3, longest + 1):
            before = known[k - 1]
            first = _filter(before.where("fore >= mark"), k - 1)
            last = _filter(before.where("aft >= mark"), k - 1)
            scored = _filter(before.where("s.score >= mark"), k - 1) if k == longest else None
            rule = _frequent_only(frequent, _rule(first, last, k == longest, scored))
            grown = _known(count(k, rule), before, k, False)
            known[k] = cut_lineage(grown.join(marks, "lang"))
        found = cut_lineage(_survivors(known, longest, inside))
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
        done = marks.join(enough, "lang", "left").where(f"mark = 0 or held >= {top}").select("lang")
        done = cut_lineage(done)
        settled.append(found.join(done, "lang"))
        open_langs = cut_lineage(open_langs.join(done, "lang", "left_anti"))
        if open_langs.isEmpty():
            break
        reach *= 4
    best = _best(reduce(DataFrame.unionByName, settled), level1, top, longest)
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score"
    )


def _thresholds(pairs: DataFrame, reach: int) -> DataFrame:
    """Per language the score that ``reach`` pairs attain, or 0 where there are fewer.

    Scores are counted first, so a window holds each of a language's scores once.
    """
    counts = pairs.groupBy("lang", F.col("s.score").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    attained = counts.withColumn("above", F.sum("n").over(down))
    mark = F.max(F.when(F.col("above") >= reach, F.col("score")))
    return attained.groupBy("lang").agg(F.coalesce(mark, F.lit(0)).cast("long").alias("mark"))


def _survivors(known: dict[int, DataFrame], longest: int, inside: int) -> DataFrame:
    out = []
    for k, phrases in known.items():
        scored = phrases.where("s.score >= mark")
        if k < longest:
            held = _longest_extension(known[k + 1], k)
            scored = scored.join(held, _names(k), "left").where(
                F.col("held").isNull() | (100 * F.col("held") < inside * F.col("n"))
            )
        padding = [F.lit(None).cast("long").alias(c) for c in _names(longest - k, k + 1)]
        out.append(scored.select("lang", *_names(k), *padding, "n", "s.score", "s.l", "s.r"))
    return reduce(DataFrame.unionByName, out)


def _best(found: DataFrame, words: DataFrame, top: int, longest: int) -> DataFrame:
    """The first ``top`` of each language: of every part of it first, then of what they leave."""
    named = found
    for c in _names(longest):
        own = words.select(F.col("w1").alias(c), F.col("word").alias(f"{c}_word"))
        named = named.join(own, c, "left")
    phrase = F.concat_ws(" ", *[f"{c}_word" for c in _names(longest)])
    named = named.select("lang", "n", "score", "l", "r", phrase.alias("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(found)))
    order = [F.desc("score"), F.desc("n"), F.asc("phrase")]
    some = named.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    )
    ranked = some.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.where(F.col("rank") <= top).drop("part")
