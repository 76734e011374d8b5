"""Source mixing (op11), spelling variants (op12) and phrases (op13) beside plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabwright.llm import collocations, mixing, spelling
from tests.llm.helpers import LOWER, SHINGLE_WORD, awkward, key, prose, table

# Source mixing


def plain_mix(rows, weights=(1, 2, 3), most=3, total=None, seed=0):
    """Targets by sharing again and again, then documents in the order of their digests."""
    size = [len(SHINGLE_WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    rest = Fraction(sum(size) if total is None else total)
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if most * own[s] <= rest * weight[s] / w}
        if not full:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: Fraction(most * own[s]) for s in full}
        rest -= sum(most * own[s] for s in full)
        free -= full
    digest = lambda i, t: hashlib.md5(
        f"{seed}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()
    ).hexdigest()
    out = []
    for s in sources:
        left = int(target[s] + Fraction(1, 2))
        epochs, left = divmod(left, own[s]) if own[s] else (0, 0)
        for d, k in sorted((digest(r[0], r[1]), k) for k, r in enumerate(rows) if r[2] == s):
            part = min(left, size[k])
            left -= part
            out.append((rows[k][0], size[k], own[s], float(target[s]), epochs * size[k] + part))
    return out


def mixed(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)


@pytest.mark.parametrize("most, total, weights", [(3, None, (1, 2, 3)), (2, 9000, (5, 1)), (3, 10**6, (1,)), (1, 0, (2, 1))])
def test_mix_equals_plain_version(spark, most, total, weights):
    rows = awkward() + [(100 + k, prose(k, 1 + 37 * k % 90), "big" if k % 3 else f"s{k % 7}") for k in range(80)]
    got = mixing.mix(table(spark, rows), weights, most, total, range_rows=7)
    assert mixed(got) == sorted(plain_mix(rows, weights, most, total), key=key)


def test_mix_keeps_other_columns_and_reads_texts_once(spark):
    docs = table(spark, awkward()).withColumn("size", F.lit("old")).withColumn("row", F.lit(1)).withColumn("src", F.lit(2))
    got = mixing.mix(docs, range_rows=2)
    assert [c for c in got.columns if c not in ("size", "source_size", "target", "taken")] == [c for c in docs.columns if c != "size"]
    slim = mixing.mix(docs, range_rows=2, keep_text=False)
    assert "text" not in slim.columns and mixed(slim) == mixed(got)


def test_budget_that_ends_among_copies(spark):
    rows = [(1, "one two three", "a")] * 50 + [(2, prose(1, 400), "b")]
    got = mixing.mix(table(spark, rows), (1, 4), range_rows=3).where("source = 'a'").collect()
    assert sum(r["taken"] for r in got) == 110
    assert Counter(r["taken"] for r in got) == Counter(x[4] for x in plain_mix(rows, (1, 4)) if x[0] == 1)


def test_mix_of_an_empty_table(spark):
    docs = table(spark, awkward()).where("false")
    got = mixing.mix(docs)
    assert got.count() == 0 and mixing.epochs(got).count() == 0


def test_epochs_are_whole_texts_and_one_cut(spark):
    rows = [(1, "  a b\tc  d ", "x"), (2, prose(4, 20_000), "x"), (3, prose(5, 50), "y"), (4, None, "y"), (5, "u v", "y")]
    got = mixing.mix(table(spark, rows), (7, 1))
    taken = {r["doc_id"]: r["taken"] for r in got.collect()}
    seen, text = Counter(), {i: t for i, t, _ in rows}
    for r in mixing.epochs(got).collect():
        words = SHINGLE_WORD.findall(r["text"])
        assert len(words) == r["words"] and text[r["doc_id"]].startswith(r["text"])
        seen[r["doc_id"]] += len(words)
    assert seen == Counter({i: n for i, n in taken.items() if n})


# Spelling variants


def plain_words(rows, least=7, count=2, loss=31):
    found = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if loss and h % loss == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(found):
    near = {w: [v for v in found if one_edit(w, v)] for w in found}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-found[v], v), default=None)
        form[w] = best if best is not None and found[best] >= 10 * found[w] else None
    out = []
    for w, n in found.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), found.get(form[w])))
    return out


def vocabulary(spark, found):
    return spark.createDataFrame(list(found.items()), "word string, n long")


def edited(rng, w, letters):
    k, c = rng.randrange(len(w) + 1), rng.choice(letters)
    return rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])


@pytest.mark.parametrize("letters, least", [("ab", 0), ("abcdéÿ", 4), ("abcdefghijklmnop", 7)])
def test_neighbours_equal_brute_force(spark, letters, least):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(least + rng.randrange(5))) for _ in range(150)}
    for _ in range(2):
        words |= {edited(rng, w, letters) for w in list(words) if w}
    long = "".join(rng.choice(letters) for _ in range(3000))
    words |= {long, long[:1500] + long[1501:], long + letters[0], letters[-1] + long, long[:700] + "é" + long[701:]}
    found = {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in words}
    got = spelling.neighbours(vocabulary(spark, found)).select("word", "other").collect()
    want = {(a, b) for a in found for b in found if one_edit(a, b)}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    got = spelling.variants(vocabulary(spark, found)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_variants(found), key=key)


def test_words_of_documents(spark):
    rows = [(i, t) for i, t, _ in awkward()] + [
        (20, "Straßenbahn STRAßENBAHN straßenbahn; naïvetés×÷ÿ Ωmega-alphabet"),
        (20, "Straßenbahn STRAßENBAHN straßenbahn; naïvetés×÷ÿ Ωmega-alphabet"),
        (21, "x" * 30_000 + " " + "x" * 30_000),
        *((30 + k, "wonderful Wonderful marvellous " * 3) for k in range(60)),
    ]
    got = dict(map(tuple, spelling.words(table(spark, rows)).collect()))
    assert got == plain_words(rows) and "straßenbahn" in got and len(got) > 4
    got = spelling.spelling_variants(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_variants(plain_words(rows)), key=key)
    assert spelling.spelling_variants(table(spark, rows).where("false")).count() == 0


# Phrases


def plain_phrases(rows, support, top, inside=80, longest=4):
    out = []
    counts, totals = {}, Counter()
    for t, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        named = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        held = {}
        for p, a in named.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held.get(p[i : i + n], 0), a)
        best = []
        for p, a in named.items():
            if 100 * held.get(p, 0) >= inside * a:
                continue
            score, _, left, right = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, k, p.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows(seed, docs):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(40)]
    fixed = [[rng.choice(pool) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice(fixed) if rng.random() < 0.4 else [pool[int(40 * rng.random() ** 2)]]
            words[-1] += rng.choice(["", "", "", ",", ".", "\n", "\t", " é", " 　x"])
        rows.append((" ".join(words).title() if k % 3 else " ".join(words), ["en", "de", None, "und"][k % 4]))
    return rows


@pytest.mark.parametrize("support, top, longest", [(5, 10, 4), (3, 40, 4), (2, 5000, 4), (4, 15, 5), (4, 8, 2), (3, 3, 3)])
def test_phrases_equal_brute_force(spark, support, top, longest):
    rows = [*phrase_rows(7, 120), (None, "en"), ("", "fr"), ("a b " * 3000, "long"), (" \n\t ", "en"), ("x " * 50, "x")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("w1", F.lit(1)).withColumn("n", F.lit("n"))
    got = collocations.collocations(docs, support=support, top=top, longest=longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, support, top, longest=longest))


def test_words_that_share_a_hash(spark):
    rows = phrase_rows(8, 60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    seeds = collocations.word_counts(docs.na.fill("und"), 4, hash_bits=13)[2].keywords["seed"]
    got = collocations.collocations(docs, support=4, top=20, hash_bits=13)
    assert seeds > 0 and sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, 4, 20))


def test_no_phrases(spark):
    docs = table(spark, awkward())
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs, support=10**6).count() == 0
