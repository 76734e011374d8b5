"""Near-duplicates by SimHash, found through deletion-variant signatures.

Fingerprints of 64 bits that differ in at most ``k`` bits are cut into ``k // 2 + 1``
segments, so that one segment differs by at most one bit. For every segment and every bit
of it the fingerprint is indexed under the segment with that bit wiped out: two segments
that differ by at most one bit share such a variant. Equal variants meet in one bucket and
are verified on all 64 bits.

Equal fingerprints are one node. Within a bucket only links that join its parts are given
out, never all pairs. Buckets hold at most ``BUCKET`` nodes: segment values that are more
frequent than half of that are known beforehand from counts, and their nodes are linked
another way, through their neighbours at half the distance: fingerprints at most ``k`` bits
apart have a common neighbour within ``k // 2`` bits (rounded up for one of them), and all
that share such a neighbour are linked to its smallest by an aggregation.

A distance too wide for one fingerprint (``wide_links``) takes ``FINGERPRINTS`` independent
ones, each cut into four segments. Two fingerprints whose segments differ by at most one bit
agree in one of its halves: they are dealt by the halves, the other half's variants are made
where its rows lie, and equal variants are verified on ``CHECKED`` fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix, partitions, ship, tidy
from .components import components
from .tokens import slices

SHINGLE_WORDS = 4
MAX_DIFFERENT = 4
BUCKET = 1 << 14
SEED = 42
#: Independent fingerprints of a set, and how many of them a pair is verified on.
FINGERPRINTS, CHECKED = 10, 3
#: Most bits that differ in the checked fingerprints. At a similarity of 0.8 a bit differs with a probability of at
#: most 0.152 (0.188 for sets of four and five): 29 bits of 192, with a deviation of 5.
WIDE_DIFFERENT = 45
#: Up to this size all pairs of a bucket are compared at once, and up to the second one its unlike rows are left out first.
PAIRED, SIEVED = 32, 2048
#: Links that a task holds before it reduces them to those that join parts.
HELD = 1 << 18


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A text's fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    stop = (start + size)[words - 1 :].tolist()
    found = [hashed(joined[a:b], SEED) for a, b in zip(start.tolist(), stop, strict=False)]
    n = len(found)
    count = np.zeros(64, np.int64)
    values = np.array(found, "<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 14):
        count += np.unpackbits(values[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row and ``fp``, its fingerprint as a signed long."""
    ship(docs.sparkSession)
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t, words) for t in b.column("__text").to_pylist()], np.uint64)
            columns = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def segments(k: int) -> list[tuple[int, int]]:
    """First bit and width of each of the k // 2 + 1 segments."""
    cuts = np.linspace(0, 64, k // 2 + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def local_links(fps: np.ndarray, k: int) -> np.ndarray:
    """Links (pairs of rows) that join every connected part of a few fingerprints.

    Parts grow from their smallest node: each reached node is compared with those not
    yet reached only, so a bucket of near copies costs little more than its size.
    """
    left = np.sort(fps)
    out = []
    while len(left):
        reached = [left[0]]
        root, left = left[0], left[1:]
        while reached and len(left):
            near = np.bitwise_count(left ^ reached.pop()) <= k
            if near.any():
                got = left[near]
                out.append(np.stack([np.full(len(got), root), got], 1))
                reached.extend(got)
                left = left[~near]
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def _bucket_links(variants: DataFrame, k: int) -> DataFrame:
    """Links within buckets: rows ``key, fp`` sorted by key, in streams."""

    def links(fps: np.ndarray, keys: np.ndarray) -> Iterator[np.ndarray]:
        """Of whole buckets: pairs at once, larger buckets each on its own."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= k
        yield np.stack([a[near], b[near]], 1)
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            yield local_links(fps[s : s + n], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_rest, fp_rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def given(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *pairs]), axis=0).view(np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key_rest, batch.column("key").to_numpy()])
            fp = np.concatenate([fp_rest, batch.column("fp").to_numpy().view(np.uint64)])
            # The last bucket may go on in the next batch; a bucket is bounded by BUCKET.
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield from given(links(fp[:cut], key[:cut]))
            key_rest, fp_rest = key[cut:], fp[cut:]
        if len(key_rest):
            yield from given(links(fp_rest, key_rest))

    return variants.mapInArrow(run, "a long, b long")


def _half_way(fps: DataFrame, k: int) -> DataFrame:
    """Links of frequent segments' nodes: through neighbours at half the distance."""
    near, far = k // 2, k - k // 2
    flips = [sum(1 << b for b in c) for r in range(far + 1) for c in combinations(range(64), r)]
    masks = np.array(flips, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for at in range(0, len(fp), 256):
                own = np.repeat(fp[at : at + 256], len(masks))
                middle = (fp[at : at + 256, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(middle), pa.array(own)], names=["middle", "fp"])

    around = fps.mapInArrow(run, "middle long, fp long")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    if near == far:
        least = around.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("m")).where("a <> m")
        return around.join(least, "middle").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    # An odd distance: a node within ``near`` links all those within ``far``.
    least = around.where(apart <= near).groupBy("middle").agg(F.min("fp").alias("a"))
    return around.join(least, "middle").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, k: int = MAX_DIFFERENT, bucket: int = BUCKET) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all pairs at most ``k`` bits apart.

    ``fps`` has distinct fingerprints in the column ``fp``.
    """
    parts = segments(k)
    rows = fps.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), a, w).alias("v")) for s, (a, w) in enumerate(parts)))).alias("x")
    ).select("fp", "x.s", "x.v")
    counts = rows.groupBy("s", "v").count()
    frequent = cut_lineage(counts.where(F.col("count") > bucket // 2).select("s", "v"))
    everything = []
    if frequent.isEmpty():
        usual = fps
        variant_ok = None
    else:
        # A variant is left out if a frequent value falls under it; those nodes go half way.
        flips = F.array(*(F.lit(1 << j).cast("long") for j in range(max(w for _, w in parts))))
        around = frequent.select("s", "v", F.explode(flips).alias("m"))
        own = frequent.select("s", "v", F.lit(-1).cast("long").alias("mask"))
        beside = around.select("s", F.col("v").bitwiseXOR(F.col("m")).alias("v"), F.col("m").alias("mask"))
        masks = own.union(beside).groupBy("s", "v").agg(F.bit_or("mask").alias("mask"))
        marked = rows.join(masks, ["s", "v"], "left").select("fp", "s", F.coalesce("mask", F.lit(0)).alias("mask"))
        per = marked.groupBy("fp").agg(*(F.max(F.when(F.col("s") == s, F.col("mask"))).alias(f"m{s}") for s in range(len(parts))))
        usual = cut_lineage(per)
        variant_ok = [F.col(f"m{s}") for s in range(len(parts))]
        hot = usual.where(" or ".join(f"m{s} <> 0" for s in range(len(parts)))).select("fp")
        everything.append(_half_way(hot, k))
    variants = []
    for s, (first, width) in enumerate(parts):
        value = _segment(F.col("fp"), first, width)
        for j in range(width):
            # A key names segment and bit, and holds the segment's other bits.
            rest = value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j)))
            key = rest.bitwiseOR(F.lit((s * 64 + j) << 40))
            if variant_ok is not None:
                key = F.when(variant_ok[s].bitwiseAND(F.lit(1 << j)) == 0, key)
            variants.append(key)
    spread = usual.select("fp", F.explode(F.array(*variants)).alias("key")).where("key is not null")
    spread = spread.repartition(partitions(fps), "key").sortWithinPartitions("key")
    everything.append(_bucket_links(spread.select("key", "fp"), k))
    out = everything[0]
    for more in everything[1:]:
        out = out.union(more)
    return out


def groups(rows: DataFrame, k: int = MAX_DIFFERENT, bucket: int = BUCKET) -> DataFrame:
    """``fp`` and ``root`` of every distinct fingerprint in ``rows``: equal roots are connected."""
    nodes = cut_lineage(rows.select("fp").distinct())
    found = components(links(nodes, k, bucket))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    k: int = MAX_DIFFERENT,
    words: int = SHINGLE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row.

    A component holds all rows that reach each other over fingerprints at most ``k``
    bits apart; its id is its smallest ``doc_id`` (null ids count only where a component
    has no other). Null and blank texts have the fingerprint zero, linked like any other.
    Every input row gives one row, repeated ids included; an empty table gives none.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut_lineage(fingerprints(named, words, "text", ("doc_id",)))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = cut_lineage(groups(rows, k, bucket).join(first, "fp"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    owners = joined.join(names, "root").select("fp", "component_id")
    return rows.join(owners, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame,
    k: int = MAX_DIFFERENT,
    words: int = SHINGLE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """The rows of ``docs`` that stay when of every group of near-duplicates one does.

    The one with the smallest id stays (null ids last; equal ids by a hash of the text; of
    rows equal in both, any one). Groups are those of ``near_duplicates``.
    """
    named = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text")
    )
    rows = cut_lineage(fingerprints(named, words, "text", ("id", "th")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    least = rows.groupBy("fp").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(
        groups(rows, k, bucket).join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
    ).select(F.col("least.id").alias("__id"), F.col("least.th").alias("__th"))
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    stay = hashed.join(kept, same, "left_semi")
    repeated = rows.groupBy("id", "th").count().where("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([doc_id, "__hash"])
    return stay.select(*docs.columns)


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, FINGERPRINTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``FINGERPRINTS`` fingerprints of a set of hashes, each by a scrambling of its own."""
    count = np.zeros((FINGERPRINTS, 8, 8), np.int64)
    # A byte of the sums counts up to 255.
    for at in range(0, len(hashes), 255):
        own = mix(hashes[at : at + 255, None] * _FACTORS[0] + _FACTORS[1])
        for j in range(8):
            lanes = ((own >> np.uint64(j)) & _LANES).sum(0, dtype=np.uint64)
            count[:, :, j] += lanes.astype("<u8").view(np.uint8).reshape(FINGERPRINTS, 8)
    bits = 2 * count.reshape(FINGERPRINTS, 64) > len(hashes)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _halves(nodes: DataFrame) -> DataFrame:
    """A row per node and byte of its sketch: ``key`` (the byte, a half segment), its columns and the fingerprints to check."""
    columns = [c for c in nodes.columns if c != "fps"]
    checked = [f"f{i}" for i in range(CHECKED)]
    schema = ", ".join(["key int", *(f"{c} long" for c in (*columns, *checked))])
    halves = FINGERPRINTS * 8
    places = np.arange(halves, dtype=np.int32) << 8
    of = np.arange(halves) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            fps = b.column("fps").flatten().to_numpy().reshape(-1, FINGERPRINTS)
            own = np.ascontiguousarray(fps).astype("<i8").view(np.uint8).reshape(-1, halves)
            arrays = [pa.array((own + places).ravel().astype(np.int32))]
            arrays += [pa.array(np.repeat(b.column(c).to_numpy(), halves)) for c in columns]
            arrays += [pa.array(fps[:, (of + i) % FINGERPRINTS].ravel()) for i in range(CHECKED)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *columns, *checked])

    return nodes.select(*columns, "fps").mapInArrow(tidy(run), schema)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of rows sorted by key, cut between keys."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = {c: b.column(c).to_numpy() for c in b.schema.names}
        key = now["key"]
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut or (held and held[-1]["key"][-1] != key[-1]):
            held.append({c: x[:cut] for c, x in now.items()})
            yield {c: np.concatenate([h[c] for h in held]) for c in now}
            held = []
        held.append({c: x[cut:] for c, x in now.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _near(fps: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    return sum((np.bitwise_count(f[i] ^ f[j]) for f in fps[1:]), np.bitwise_count(fps[0][i] ^ fps[0][j])) <= most


def _grown(rows: np.ndarray, fps: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every connected part of a bucket's rows, as in ``local_links``."""
    if len(rows) <= SIEVED:
        met = [_near(fps, rows[at : at + 256, None], rows[None, :], most).sum(1) > 1 for at in range(0, len(rows), 256)]
        rows = rows[np.concatenate(met)]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = rows
    while len(left):
        root, left = left[0], left[1:]
        reached = [root]
        while reached and len(left):
            near = _near(fps, reached.pop(), left, most)
            if near.any():
                got = left[near]
                first.append(np.full(len(got), root))
                second.append(got)
                reached.extend(got)
                left = left[~near]
    return np.concatenate(first), np.concatenate(second)


def _met(rows: dict[str, np.ndarray], most: int, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers that share a variant and are near; with ``apart`` all that differ in ``root``."""
    key = rows["key"].astype(np.int64)
    fps = [rows[f"f{i}"].view(np.uint64) for i in range(CHECKED)]
    other = (8 * (((key >> 8) ^ 1) % 8)).astype(np.uint64)
    half = ((fps[0] >> other) & np.uint64(255)).astype(np.int64)
    for j in range(8):
        value = (key << 8) | (half & ~(1 << j))
        order = np.argsort(value, kind="stable")
        value = value[order]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(value)]]))
        at = np.flatnonzero(value[1:] == value[:-1])
        if not apart:
            at = at[np.repeat(sizes, sizes)[at] <= PAIRED]
            for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
                yield _grown(order[s : s + n], fps, most)
        d = 1
        while len(at):
            a, b = order[at], order[at + d]
            if apart:
                differ = rows["root"][a] != rows["root"][b]
                a, b = a[differ], b[differ]
            near = _near(fps, a, b, most)
            yield a[near], b[near]
            d += 1
            at = at[at + d < len(value)]
            at = at[value[at + d] == value[at]]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Links from the smallest node of every connected part to its others."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        ends = root[flat]
        ends = ends[ends[:, 0] != ends[:, 1]]
        if not len(ends):
            break
        np.minimum.at(root, ends.max(1), ends.min(1))
        while (root != root[root]).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[other]], nodes[other]], 1)


def wide_links(nodes: DataFrame, most: int = WIDE_DIFFERENT, apart: bool = False) -> DataFrame:
    """Links (``a``, ``b``) between nodes whose sketches share a variant and are near on the checked fingerprints.

    ``nodes`` has ``node`` (long) and ``fps`` (its sketch). Without ``apart`` only links that
    join the parts of a task's rows are given out, so near copies do not make all their pairs. With
    it ``nodes`` also has ``root``, and every pair of two roots is given. A pair may come more than once.

    Two sets of similarity 0.8 share a variant of one of the 40 segments but for a probability
    of 3e-6 (6e-4 for sets of four and five). A segment brings one of 3,900 unlike pairs together, which
    costs a comparison of fingerprints.
    """
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        def less(pairs: list[np.ndarray]) -> np.ndarray:
            found = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
            return np.unique(np.sort(found, axis=1), axis=0) if apart else _forest(found)

        pairs, n = [], 0
        for rows in _whole_keys(batches):
            for a, b in _met(rows, most, apart):
                if len(a):
                    pairs.append(np.stack([rows["node"][a], rows["node"][b]], 1))
                    n += len(a)
                if n > HELD:
                    pairs = [less(pairs)]
                    n = len(pairs[0])
                    if 2 * n > HELD:
                        yield from given(pairs[0])
                        pairs, n = [], 0
        yield from given(less(pairs))

    columns = ["node", "root", "fps"] if apart else ["node", "fps"]
    some = nodes.select(*columns).where(F.size("fps") > 0).repartition(partitions(nodes))
    dealt = _halves(some).repartition(partitions(nodes), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(run), "a long, b long")
