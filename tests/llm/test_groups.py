"""SimHash (op5), nearest neighbours (op6), shards (op8)."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabwright.llm import ann, components, sharding, simhash
from tests.llm.helpers import LOWER, SHINGLE_WORD, awkward, key, prose, table


def plain_fingerprint(text, words=4):
    w = SHINGLE_WORD.findall((text or "").translate(LOWER))
    g = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_copies():
    out = []
    for k in range(4):
        words = prose(900 + k, 300).split()
        for j in range(6):
            own = list(words)
            own[10 * j + 3] = f"changed{j}"
            out.append((100 + 10 * k + j, " ".join(own)))
    return out


def test_fingerprints_equal_brute_force():
    for _, t, _ in awkward():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i, t) for i, t, _ in awkward()] + near_copies()
    got = simhash.near_duplicates(table(spark, rows)).collect()
    fps = {plain_fingerprint(t) for _, t in rows}
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[plain_fingerprint(t)]
            least[r] = min(least.get(r, i), i)
    want = [(i, np.uint64(f := plain_fingerprint(t)).astype(np.int64).item(), least.get(root[f])) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(set(root.values())) < len(fps)


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, t, _ in awkward()] + near_copies()
    docs = table(spark, rows)
    fps = {plain_fingerprint(t) for _, t in rows}
    groups = set(plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4).values())
    ids = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(groups)
    assert {r["doc_id"] for r in left} == ids
    assert simhash.keep_one(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("k", [3, 4])
@pytest.mark.parametrize("bucket", [1 << 14, 6, 1])
def test_links_join_what_all_pairs_join(spark, k, bucket):
    rng = random.Random(k)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(10):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 15, 31}
    rows = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")
    found = components.components(simhash.links(rows, k, bucket)).collect()
    mine = {r["node"]: r["component"] for r in found}
    signed = [np.uint64(x).astype(np.int64).item() for x in fps]
    want = plain_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= k)
    assert {x: mine.get(x, x) for x in signed} == want


def test_local_links_are_few():
    rng = np.random.default_rng(0)
    base = np.uint64(12345)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)))
    assert len(simhash.local_links(fps, 4)) == len(fps) - 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert {r["node"]: r["component"] for r in got} == want
    assert len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(vectors, query, n):
    own = [(i, v) for i, v in vectors if i == query][0][1]
    scored = sorted(
        (-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in vectors if i != query and len(v) == len(own)
    )
    return [(i, -s) for s, i in scored[:n]]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int")


def test_neighbours_with_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(60)]
    same = good[3][1]
    good += [(i, same) for i in range(60, 100)]
    bad = [(200, None), (220, [0.0] * 8), (240, [1.0, None] * 4), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (300, [])]
    rows = [(i, v, 1, 2) for i, v in [*good, good[5], *bad]] + [(None, same, 1, 2)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, tables=4, probes=4, cell_rows=16, cell_queries=2).collect()
    asked = {i for i, _ in good if i % 20 == 0}
    assert {r["query_id"] for r in got} == asked
    hits = 0
    for q in asked:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        want = brute(good, q, 20)
        hits += len({i for _, i, _ in own} & {i for i, _ in want})
        assert all(a[2] >= b[2] and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(own, own[1:], strict=False))
    assert hits >= 0.9 * 20 * len(asked)


def test_few_vectors_are_all_found(spark):
    rows = [(i, [float(i + 1), 1.0], 0, 0) for i in range(5)] + [(20, [1.0, 2.0, 3.0], 0, 0)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_rotations_keep_lengths_and_buckets_are_distinct():
    x = np.random.default_rng(2).normal(size=(50, 48))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    for turns in (1, 2):
        found = ann.buckets(x, 1, 6, turns)
        assert all(len(set(r)) == 6 for r in found.tolist())
        assert (found[:, :1] == ann.buckets(x, 1, 1, turns)).all()


def test_shards(spark):
    rows = [(i, t) for i, t, _ in awkward()] + [(1000 + k, prose(k, 20 + k % 50)) for k in range(600)]
    docs = table(spark, rows)
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(rows)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(load) - min(load) <= 0.05 * sum(load) / 4
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_maps_are_edited_and_versioned(spark, tmp_path):
    sizes = [random.Random(k).randrange(1, 100) for k in range(500)]
    first = sharding.balanced_map(sizes, 5)
    grown = sharding.rebalanced(first, sizes, 6)
    moved = [s for s in range(500) if grown.owner[s] != first.owner[s]]
    assert moved and {grown.owner[s] for s in moved} == {5}
    load = [sum(sizes[s] for s in range(500) if grown.owner[s] == k) for k in range(6)]
    assert max(load) - min(load) <= 2 * max(sizes)
    shrunk = sharding.rebalanced(grown, sizes, 4)
    assert set(shrunk.owner) == {0, 1, 2, 3}
    for m in (first, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 2) == grown
    assert re.search("version=000001", " ".join(p.name for p in (tmp_path / "map").iterdir()))
