"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. *Voters.* Words and word beginnings that mark toxic texts are mined from a bounded sample
   of labelled rows: of those with high odds, the ones that cover most of the toxic rows that
   are not yet covered ``DEPTH`` times. They are dealt into lexicon voters (whole words) and
   pattern voters (beginnings); a fixed lexicon and two form patterns vote as well. A voter
   votes "toxic" or abstains.
2. *Label model.* Votes of all documents outside the held-out fold are counted by vote
   pattern. Iterated over these counts, a voter's rates on toxic and on clean texts, and so its
   accuracy, are solved from its agreement with what the other voters make of the texts; its
   own vote is left out, so it cannot confirm itself. The start is its precision on the sample.
   Voters that vote together more than the class explains are
   correlated and share their weight.
3. *Classifier.* A logistic regression over the mined features is fitted to the label model's
   posteriors on a bounded sample of rows, and scores every text.

Held-out rows (crc32 of the id as text, mod 5, is 0) give no labels. Labels, language, source
and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ship, tidy
from .tokens import slices

SAMPLE_ROWS = 20_000
FEATURES = 4096
LEXICONS = 16
PATTERNS = 16
LEAST_SUPPORT = 4
DEPTH = 3
BEGINNINGS = (4, 5)
ROUNDS = 12
CORRELATED = 0.3

# Public English insults.
LEXICON = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb vermin filth jerk".split()
_CAPITALS = bytes(range(0x41, 0x5B))
_NOT_LETTERS = re.compile(r"[\W\d_]+")
VOTERS = LEXICONS + PATTERNS + 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_NOT_LETTERS.sub(" ", text.lower()).split())


def features_of(words: set[str]) -> set[str]:
    """Whole words, and beginnings marked by a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


class Extractor:
    """Selected features and votes of a text."""

    def __init__(self, names: list[str], voter: list[int]) -> None:
        self.index = {f: i for i, f in enumerate(names)}
        self.words = {f for f in names if f[-1] != "*"}
        self.heads = {n: {f[:-1] for f in names if f[-1] == "*" and len(f) == n + 1} for n in BEGINNINGS}
        self.voter = voter
        self.fixed = frozenset(LEXICON)

    def features(self, words: set[str]) -> list[int]:
        found = list(self.words & words)
        for n, heads in self.heads.items():
            if heads:
                found += [h + "*" for h in heads & {w[:n] for w in words if len(w) > n}]
        return sorted(self.index[f] for f in found)

    def votes(self, text: str, words: set[str], features: list[int]) -> int:
        mask = 0
        for f in features:
            if self.voter[f] >= 0:
                mask |= 1 << self.voter[f]
        at = LEXICONS + PATTERNS
        mask |= (not words.isdisjoint(self.fixed)) << at
        mask |= ("!!" in text) << at + 1
        raw = text.encode("utf-8", "surrogatepass")
        capitals = len(raw) - len(raw.translate(None, delete=_CAPITALS))
        mask |= (capitals > 20 and 2 * capitals > len(raw)) << at + 2
        return mask


def _smallest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest values of a hash column (ties by the other columns).

    A bound on the hash lets only about as many rows through as are wanted, so that what
    reaches the last task does not grow with the number of partitions.
    """
    n = rows.count()
    share = 1.1 * (limit + 1000) / max(n, 1)
    if share < 1:
        rows = rows.where(F.col(key) <= F.lit(int(-(2**63) + share * 2**64)))
    return rows.orderBy(key, *[c for c in rows.columns if c != key]).limit(limit)


def _sample(labels: DataFrame, doc_id: str, label: str, rows: int) -> list[tuple[int, int]]:
    """Ids and labels of at most ``rows`` labelled rows outside the held-out fold, by hash."""
    fine = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    one = fine.groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    picked = _smallest(one.withColumn("__key", F.xxhash64(doc_id)), "__key", rows).collect()
    return [(r[doc_id], r["y"]) for r in picked]


def _mined(texts: DataFrame) -> DataFrame:
    """Rows of every feature in a toxic and in a clean text, summed over texts ``text, y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for some in slices([b]):
                for t, y in zip(some.column("text").to_pylist(), some.column("y").to_pylist(), strict=True):
                    for f in features_of(words_of(t or "")):
                        count.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(count), pa.string()),
                    pa.array([c[1] for c in count.values()], pa.int64()),
                    pa.array([c[0] for c in count.values()], pa.int64()),
                ],
                names=["f", "toxic", "clean"],
            )

    return texts.mapInArrow(tidy(run), "f string, toxic long, clean long").groupBy("f").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _covering(rows: list[list[int]], size: int) -> list[int]:
    """Features that cover the rows ``DEPTH`` times where possible, most new rows first.

    Words that only copies of one text share add nothing once that text is covered.
    """
    holders: list[list[int]] = [[] for _ in range(size)]
    for i, r in enumerate(rows):
        for f in r:
            holders[f].append(i)
    missing = np.full(len(rows), DEPTH)
    holder = [np.array(h, np.int64) for h in holders]
    gain = np.array([len(h) for h in holders])
    chosen = []
    while size and gain.max() >= 2:
        f = int(np.argmax(gain))
        # Gains only fall, so a feature whose gain is up to date is the best one.
        now = int((missing[holder[f]] > 0).sum())
        if now == gain[f]:
            chosen.append(f)
            missing[holder[f]] -= 1
            gain[f] = 0
        else:
            gain[f] = now
    return chosen


def _voters(names: list[str]) -> list[int]:
    """Each feature's voter: words into lexicons, beginnings into patterns, in turn."""
    out, lexicon, pattern = [], 0, 0
    for f in names:
        if f[-1] == "*":
            out.append(LEXICONS + pattern % PATTERNS)
            pattern += 1
        else:
            out.append(lexicon % LEXICONS)
            lexicon += 1
    return out


def _bits(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(p) - np.log1p(-p)


@dataclass
class LabelModel:
    """Voters' accuracies (the chance of toxic where they vote) and weights.

    ``prior`` is the share of toxic texts, ``none`` that among texts without a vote.
    """

    accuracy: np.ndarray
    weight: np.ndarray
    prior: float
    none: float

    def posteriors(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of toxic from all votes, and, per voter, from the others' votes."""
        votes = _bits(masks)
        prior, none = _logit(self.prior), _logit(self.none)
        each = self.weight * (_logit(self.accuracy) - prior)
        count = votes.sum(1, keepdims=True)
        total = np.where(count > 0, prior + (votes @ each)[:, None], none)
        others = np.where(count - votes > 0, prior + (votes @ each)[:, None] - votes * each, none)
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (total[:, 0], others))


def fit_label_model(
    patterns: DataFrame, accuracy: np.ndarray, prior: float, none: float, rounds: int = ROUNDS
) -> LabelModel:
    """Estimate accuracies over ``votes, n``; the sums are made where the rows are.

    Halfway the voters' correlations are estimated from the same sums.
    """
    start = np.clip(accuracy, 0.01, 0.99)
    shape = (2, VOTERS + 1, VOTERS)
    model = LabelModel(start.copy(), np.ones(VOTERS), float(np.clip(prior, 0.001, 0.5)), float(np.clip(none, 1e-4, 0.5)))

    def sums(now: LabelModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                masks, n = b.column("votes").to_numpy(), b.column("n").to_numpy().astype(float)
                votes, (p, others) = _bits(masks), now.posteriors(masks)
                total[0, :VOTERS] += (votes * (n * p)[:, None]).T @ votes
                total[0, VOTERS, :2] += (n * p).sum(), n.sum()
                total[1, 0] += n @ votes
                total[1, 1] += n @ (votes * others)
                total[1, 2] += n @ others
                total[1, 3] += n @ (others * others)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        # A partition of pattern counts gives one row of fixed size.
        found = patterns.mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(r["sums"]).reshape(shape) for r in found), np.zeros(shape))

    for k in range(rounds):
        s = sums(model)
        toxic, rows = s[0, VOTERS, :2]
        # Given the others' chance q of toxic, a voter votes with a * q + b * (1 - q): solve for a, b.
        votes, with_q, q, qq = s[1, :4]
        pq, pp = q - qq, rows - 2 * q + qq
        low = np.maximum(qq * pp - pq * pq, 1e-9)
        a = np.clip((with_q * pp - (votes - with_q) * pq) / low, 0, 1)
        b = np.clip(((votes - with_q) * qq - with_q * pq) / low, 0, 1)
        right, wrong = a * model.prior, b * (1 - model.prior)
        share = np.where(right + wrong > 0, right / np.maximum(right + wrong, 1e-12), start)
        # The precision at the start counts as ten votes.
        model.accuracy = np.clip((votes * share + 10 * start) / (votes + 10), 0.01, 0.99)
        model.prior = float(np.clip((toxic + 1) / (rows + 2), 0.001, 0.5))
        if k == rounds // 2 - 1 and toxic > 1:
            rate = np.diag(s[0, :VOTERS]) / toxic
            spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
            together = (s[0, :VOTERS] / toxic - np.outer(rate, rate)) / np.outer(spread, spread)
            np.fill_diagonal(together, 0)
            # Weak links between voters (of one language, say) are not dependence.
            model.weight = 1 / (1 + np.where(together > CORRELATED, together, 0).sum(1))
    return model


def fit_logistic(
    rows: list[list[int]], target: np.ndarray, size: int, penalty: float = 1e-4, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on presence of features, by accelerated descent."""
    n = len(rows)
    weight, bias = np.zeros(size), 0.0
    if not n:
        return weight, bias
    count = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(n), count)
    column = np.array([f for r in rows for f in r], np.int64)
    bias = float(_logit(np.clip(target.mean(), 1e-3, 1 - 1e-3)))
    # A step per feature: 4 over its share of rows, damped where rows hold many features.
    share = np.bincount(column, minlength=size) / n
    rate = 2.0 / np.maximum(share * max(1.0, math.sqrt(count.mean())), 10 / n)
    momentum_w, momentum_b = np.zeros(size), 0.0
    for _ in range(steps):
        z = bias + np.bincount(row, weights=weight[column], minlength=n)
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(column, weights=gap[row], minlength=size) + penalty * weight * share
        momentum_w = 0.8 * momentum_w - 0.2 * rate * grad
        momentum_b = 0.8 * momentum_b - 0.2 * gap.sum()
        weight, bias = weight + momentum_w, bias + momentum_b
    return weight, bias


@dataclass
class ToxicityModel:
    names: list[str]
    voter: list[int]
    weight: np.ndarray
    bias: float
    labels: LabelModel | None

    def score(self, docs: DataFrame, text: str = "text", column: str = "toxicity") -> DataFrame:
        """``docs`` with a score from 0 to 1; empty and null texts get the one of no features."""
        ship(docs.sparkSession)
        kept = [f.name for f in docs.schema.fields if f.name != column]
        names, voter, weight, bias = self.names, self.voter, self.weight, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            extract = Extractor(names, voter)
            for b in slices(batches):
                sums = [bias + float(weight[extract.features(words_of(t or ""))].sum()) for t in b.column("__body").to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(score)], names=[*kept, column])

        schema = docs.select(*kept).schema.add(column, "double")
        return docs.select(*kept, F.col(text).alias("__body")).mapInArrow(tidy(run), schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    features: int = FEATURES,
) -> ToxicityModel:
    """Mine voters, fit the label model to all documents' votes, fit the classifier.

    At most ``sample_rows`` labelled rows are learned from (those with the smallest hash of
    their id), and the classifier is fitted on as many posterior labels. Repeated labels of
    one id count by majority; null labels and labels without a document count for nothing.
    Without a toxic label in the sample nothing is mined and all scores are near 0.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = _sample(labels, doc_id, label, sample_rows)
    kind = docs.schema[doc_id].dataType.simpleString()
    # Bounded by ``sample_rows``.
    known = F.broadcast(spark.createDataFrame(sample, f"id {kind}, y int"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    labelled = rows.join(known, "id").select("text", "y")
    counts = cut_lineage(_mined(labelled))
    toxic = sum(y for _, y in sample) + 1
    clean = len(sample) - toxic + 2
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    strong = (
        counts.where((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") >= 3 * F.col("clean")))
        .withColumn("signal", odds * F.col("toxic"))
        .coalesce(64)
        .orderBy(F.desc("signal"), "f")
        .limit(features)
        .collect()
    )
    names = [r["f"] for r in strong]
    voter = [-1] * len(names)

    def cast(df: DataFrame, columns: str, extra: Iterable[str]) -> DataFrame:
        """Votes and features of texts, beside the columns ``extra``."""
        carried = list(extra)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            extract = Extractor(names, voter)
            for b in slices(batches):
                votes, found = [], []
                for t in b.column("text").to_pylist():
                    words = words_of(t or "")
                    own = extract.features(words)
                    found.append(own)
                    votes.append(extract.votes(t or "", words, own))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carried), pa.array(votes, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                    names=[*carried, "votes", "features"],
                )

        return df.mapInArrow(tidy(run), f"{columns}votes long, features array<int>")

    # Bounded by ``sample_rows`` rows and ``features`` names.
    held = cast(labelled.where("y = 1"), "", []).select("features").collect()
    chosen = _covering([r["features"] for r in held], len(names))
    names = [names[k] for k in chosen]
    voter = _voters(names)
    second = cast(labelled, "y int, ", ["y"]).groupBy("votes").agg(
        F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")
    )
    precision, none = _precision(second)
    prior = (toxic - 1) / max(len(sample), 1)
    votes = cut_lineage(
        cast(rows.where(~held_out(F.col("id"))).select("text", F.xxhash64("id").alias("key")), "key long, ", ["key"])
    )
    patterns = cut_lineage(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(64))
    model = fit_label_model(patterns, precision, prior, none)
    fitted = _smallest(votes, "key", sample_rows).select("votes", "features").collect()
    target = model.posteriors(np.array([r["votes"] for r in fitted], np.int64))[0] if fitted else np.zeros(0)
    if not names:
        target = np.minimum(target, 0.01)
    weight, bias = fit_logistic([r["features"] for r in fitted], target, len(names))
    return ToxicityModel(names, voter, weight, bias if fitted else -5.0, model)


def _precision(counts: DataFrame) -> tuple[np.ndarray, float]:
    """The share of toxic rows where each voter votes and where none does, of ``votes, toxic, n``."""
    cases = [F.expr(f"shiftright(votes, {k}) % 2") for k in range(VOTERS)] + [(F.col("votes") == 0).cast("int")]
    found = counts.agg(*(F.coalesce(F.sum(F.col(c) * x), F.lit(0)) for c in ("toxic", "n") for x in cases)).first()
    values = np.array([float(x) for x in found]).reshape(2, VOTERS + 1)
    share = (values[0] + 0.5) / (values[1] + 1)
    return share[:VOTERS], float(share[VOTERS])


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (score), ``held_out`` and ``predicted`` (1 from 0.5 on).

    One row for every input row, null and empty texts and repeated ids included; columns of
    ``docs`` with these names are replaced.
    """
    model = fit(docs, labels, doc_id, text)
    return (
        model.score(docs, text)
        .withColumn("held_out", held_out(F.col(doc_id)))
        .withColumn("predicted", (F.col("toxicity") >= 0.5).cast("int"))
    )
