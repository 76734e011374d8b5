"""The near-dedup stage: five-word shingles, similarity 0.8 or more."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tabwright.llm import shingles, simhash
from tests.llm.helpers import LOWER, SHINGLE_WORD, awkward, prose, table
from tests.llm.test_groups import plain_components


def plain_set(text, words=5):
    w = SHINGLE_WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies():
    """Texts beside copies of a similarity from 0.7 to 0.97."""
    out = []
    for k in range(40):
        words = prose(5000 + k, 200).split()
        own = list(words)
        for at in random.Random(k).sample(range(2, 198), 1 + k % 9):
            own[at] = f"changed{at}"
        out += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(own))]
    return out


def test_stage_equals_brute_force(spark):
    rows = [(i, t) for i, t, _ in awkward()] + copies()
    sets = {plain_set(t) for _, t in rows}
    ordered = sorted(sets, key=sorted)
    place = {s: n for n, s in enumerate(ordered)}
    alike = {s: similarity(a, b) for s, (a, b) in enumerate(zip(*[iter(plain_set(t) for _, t in copies())] * 2, strict=True))}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) >= 3 and sum(x < 0.8 for x in alike.values()) >= 3
    root = plain_components(range(len(ordered)), lambda a, b: similarity(ordered[a], ordered[b]) >= 0.8)
    least = {}
    for i, t in rows:
        r = root[place[plain_set(t)]]
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    docs = table(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(left, key=str) == sorted((i for none, i in least.values() if not none), key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, table(spark, []), "").count() == 0


def test_parts_are_those_of_all_pairs():
    rng = random.Random(3)
    sets = []
    for _ in range(30):
        base = rng.sample(range(4000), 60)
        for _ in range(rng.randrange(1, 9)):
            sets.append(frozenset(x if rng.random() > 0.08 else rng.randrange(4000) for x in base))
    sets += [frozenset(range(60))] * 2 + [frozenset([1])]
    want = plain_components(range(len(sets)), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    got = shingles.parts_of([np.array(sorted(s), np.uint64) for s in sets])
    assert dict(enumerate(got.tolist())) == want


def sets_around(bases, seed):
    """Sets beside others of similarity 0.8 (the least that counts) and up, small ones among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        n = rng.choice([8, 9, 18, 36, 90, 360])
        base = rng.sample(range(1 << 62), n)
        swap = n // 9 if n % 9 == 0 else 0
        out.append((base, base[swap:] + rng.sample(range(1 << 62), swap)) if swap else (base, base + rng.sample(range(1 << 62), n // 4)))
    return out


def test_candidates_come_from_fingerprints_at_a_wide_distance(spark):
    pairs = sets_around(600, 5)
    assert all(0.8 <= similarity(frozenset(a), frozenset(b)) < 0.801 for a, b in pairs)
    rows = [(2 * i + k, simhash.sketch(np.array(sorted(s), np.uint64)).view(np.int64).tolist()) for i, p in enumerate(pairs) for k, s in enumerate(p)]
    nodes = spark.createDataFrame(rows, "node long, fps array<long>")
    # One fingerprint's four bits, as op5 takes them, lose nearly all of these pairs.
    one = {n: f[0] for n, f in rows}
    assert sum(((one[2 * i] ^ one[2 * i + 1]) & (1 << 64) - 1).bit_count() <= 4 for i in range(600)) < 60
    found = {(r["a"], r["b"]) for r in simhash.wide_links(nodes).collect()}
    assert found >= {(2 * i, 2 * i + 1) for i in range(600)}
    # Unlike sets hardly ever link.
    assert len(found) < 620
    tied = spark.createDataFrame([(n, f, n // 2) for n, f in rows], "node long, fps array<long>, root long")
    apart = {(r["a"], r["b"]) for r in simhash.wide_links(tied, apart=True).collect()}
    assert apart == {(a, b) for a, b in found if a // 2 != b // 2}


def test_bits_of_a_sketch_are_majorities():
    own = np.array(sorted(random.Random(4).sample(range(1 << 62), 700)), np.uint64)
    got = simhash.sketch(own)
    for f in range(simhash.FINGERPRINTS):
        each = simhash.mix(own * simhash._FACTORS[0][f] + simhash._FACTORS[1][f]).tolist()
        assert int(got[f]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each))


def test_many_near_copies_link_without_all_pairs(spark):
    rng = random.Random(9)
    base = rng.sample(range(1 << 62), 300)
    sets = [np.array(sorted(base[3:] + rng.sample(range(1 << 62), 3)), np.uint64) for _ in range(400)]
    nodes = spark.createDataFrame([(i, simhash.sketch(s).view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, fps array<long>")
    found = simhash.wide_links(nodes).distinct()
    # 8 tasks, each with a link a node at most, and mostly to the same one.
    assert found.count() < 4 * 400
    linked = {(r["a"], r["b"]) for r in found.collect()}
    root = plain_components(range(400), lambda a, b: (b, a) in linked)
    assert set(root.values()) == {0}


def test_large_components_are_verified_in_blocks(spark):
    """A chain whose neighbours are similar, near copies of one text, and texts that are candidates only."""
    words = prose(77, 400).split()
    rows = [(i, " ".join([*(f"new{j}" for j in range(8 * i)), *words[8 * i :]])) for i in range(30)]
    rows += [(100 + i, " ".join([*prose(78, 200).split(), f"end{i}"])) for i in range(60)]
    rows += [(200 + i, " ".join(w if k % 16 or k == 0 else f"own{i}x{k}" for k, w in enumerate(prose(79, 200).split()))) for i in range(40)]
    sets = [plain_set(t) for _, t in rows]
    root = plain_components(range(len(rows)), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    want = sorted(rows[r][0] for r in set(root.values()))
    assert 0 in want and 29 not in want and 100 in want and 101 not in want and len(want) > 40
    docs = table(spark, rows)
    for part in (shingles.PART, 3000, 600, 1):
        assert sorted(r["doc_id"] for r in shingles.keep_one(docs, part=part).collect()) == want
