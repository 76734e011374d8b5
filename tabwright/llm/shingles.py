"""Near-duplicates by the Jaccard similarity of word shingles, verified on the whole sets.

A text is the set of its five-word shingles' hashes. Texts of one set are one node. SimHash
gives candidates: several independent fingerprints a set, found at a wide distance through
deletion-variant signatures (``simhash.wide_links``); the components of these links hold all
candidate pairs. Only nodes with a candidate get their sets; within a component every node that
can be reached over pairs of ``SIMILAR`` or more is found on the sets themselves, so no pair
below it links.

A component of up to ``PART`` shingles is verified in one task. A larger one is cut into blocks
of that size, what the blocks join is contracted, and candidates that are still apart are
verified pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import partitions, ship, text_hash, tidy
from .components import components
from .simhash import sketch, wide_links

SHINGLE_WORDS = 5
#: Similarity from which on two texts are near-duplicates, as a fraction.
SIMILAR = (4, 5)
#: Most shingles that are verified in one task, unless a text alone has more.
PART = 1 << 21
SEED = 42


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([hashed(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    stop = (start + size)[words - 1 :].tolist()
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(start.tolist(), stop, strict=False)], np.uint64))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, ``node`` (hash of the set of shingles in ``text``), ``n`` (its size) and ``fps`` (its fingerprints)."""
    ship(docs.sparkSession)
    schema = docs.select(*keep).schema.add("node", "long").add("n", "long").add("fps", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), []
            # One text and its set at a time, for the workers' memory.
            for i, t in enumerate(b.column("__text")):
                own = shingle_set(t.as_py(), words)
                nodes[i], sizes[i] = _node(own), len(own)
                fps.append(sketch(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(fps, pa.list_(pa.int64()))],
                names=[*keep, "node", "n", "fps"],
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(tidy(run), schema)


def parts_of(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """For each set the first one that it reaches over pairs of at least the similarity.

    Parts grow from their first set: a reached set is compared with those not yet reached, by
    its own shingles' postings or over what is left, whichever is less to read.
    """
    over, under = similar
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    terms, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(flat, kind="stable")]
    posted = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(terms)))])
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        reached = [first]
        while reached and len(left):
            i = reached.pop()
            own = flat[start[i] : start[i + 1]]
            if (posted[own + 1] - posted[own]).sum() <= size[left].sum():
                found = np.concatenate([np.zeros(0, np.int64), *(owner[a:b] for a, b in zip(posted[own].tolist(), posted[own + 1].tolist(), strict=True))])
                common = np.bincount(found, minlength=n)[left]
            else:
                mark = np.zeros(len(terms), np.int64)
                mark[own] = 1
                common = np.array([mark[flat[start[j] : start[j + 1]]].sum() for j in left.tolist()], np.int64)
            near = (under + over) * common >= over * (size[i] + size[left])
            if near.any():
                root[left[near]] = first
                reached.extend(left[near].tolist())
                left = left[~near]
    return root


def _verified(found: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """``node`` and ``root`` of rows ``part, node, text`` sorted by part, in streams of whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def given() -> Iterator[pa.RecordBatch]:
            if nodes:
                own = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[parts_of(sets, similar)])], names=["node", "root"])

        for b in batches:
            parts, own = b.column("part").to_pylist(), b.column("node").to_pylist()
            for part, node, text in zip(parts, own, b.column("text"), strict=True):
                if part != now:
                    yield from given()
                    now, nodes, sets = part, [], []
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), words))
        yield from given()

    return found.mapInArrow(tidy(run), "node long, root long")


def _similar(pairs: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """``a`` and ``b`` of rows ``a, b, one, two`` whose texts are similar."""
    over, under = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = shingle_set(one.as_py(), words), shingle_set(two.as_py(), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append((under + over) * common >= over * (len(x) + len(y)))
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.mapInArrow(tidy(run), "a long, b long")


def _large(found: DataFrame, words: int, similar: tuple[int, int], part: int) -> DataFrame:
    """``node`` and ``root`` of components with more than ``part`` shingles: rows ``part, node, n, fps, text``."""
    owners = cut_lineage(found.select("part", "node", "n", F.col("node").alias("root")))
    left = found.count()
    while True:
        # Of every group its first node, in blocks by a hash.
        first = owners.where("node = root")
        blocks = first.groupBy("part").agg(F.ceil(2 * F.sum("n") / part).alias("blocks"))
        dealt = first.join(blocks, "part").select("node", F.xxhash64("part", F.pmod(F.xxhash64("node", F.lit(left)), "blocks")).alias("part"))
        texts = dealt.join(found.select("node", "text"), "node").select("part", "node", "text")
        roots = _verified(texts.repartition(partitions(found), "part").sortWithinPartitions("part"), words, similar)
        moved = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
        owners = cut_lineage(owners.join(moved, "root").select("part", "node", "n", F.col("to").alias("root")))
        now = owners.where("node = root").count()
        # Blocks are dealt anew while that still halves the groups.
        if 2 * now > left:
            break
        left = now
    apart = found.select("node", "fps").join(owners.select("node", "root"), "node")
    pairs = cut_lineage(wide_links(apart, apart=True).distinct())
    texts = found.select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b"
    )
    links = cut_lineage(_similar(both.select("a", "b", "one", "two"), words, similar))
    of = owners.select("node", "root")
    ends = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(ends.distinct()).select(F.col("node").alias("root"), "component")
    return of.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("root"))


def keep_one(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    similar: tuple[int, int] = SIMILAR,
    doc_id: str = "doc_id",
    text: str = "text",
    part: int = PART,
) -> DataFrame:
    """The rows of ``docs`` that stay when of every group of near-duplicates one does.

    A group holds all rows that reach each other over pairs of texts whose sets of shingles
    (``words`` words, in ASCII lower case) have a Jaccard similarity of ``similar`` or more. The
    row with the smallest id stays (null ids last; equal ids by a hash of the text; of rows
    equal in both, any one). Null and blank texts are one group; texts of up to ``words`` words
    match equal ones only. Pairs are found with the probability that ``simhash.wide_links`` gives.
    """
    named = docs.select(F.col(doc_id).alias("id"), text_hash(text).alias("th"), F.col(text).alias("text"))
    rows = cut_lineage(sketches(named, words, ("id", "th")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("fps").alias("fps")))
    coarse = components(wide_links(nodes))
    asked = nodes.join(coarse, "node").select(
        "node", "n", F.col("component").alias("part"), F.col("least.id").alias("__id"), F.col("least.th").alias("__th")
    )
    large = cut_lineage(asked.groupBy("part").agg(F.sum("n").alias("all")).where(F.col("all") > part).select("part"))
    some = not large.isEmpty()
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    texts = named.join(asked, same).select("part", "node", "n", "text")
    repeated = not rows.groupBy("id", "th").count().where("count > 1").isEmpty()
    if repeated:
        texts = texts.dropDuplicates(["node"])
    if some:
        texts = cut_lineage(texts)
    whole = texts.join(large, "part", "left_anti") if some else texts
    dealt = whole.select("part", "node", "text").repartition(partitions(docs), "part").sortWithinPartitions("part")
    roots = _verified(dealt, words, similar)
    if some:
        cut = texts.join(large, "part", "left_semi").join(nodes.select("node", "fps"), "node")
        roots = roots.union(_large(cut_lineage(cut.select("part", "node", "n", "fps", "text")), words, similar, part))
    roots = cut_lineage(roots)
    kept = cut_lineage(
        nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    ).select(F.col("least.id").alias("__id"), F.col("least.th").alias("__th"))
    hashed = docs.withColumn("__hash", text_hash(text))
    stay = hashed.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    if repeated:
        stay = stay.dropDuplicates([doc_id, "__hash"])
    return stay.select(*docs.columns)
