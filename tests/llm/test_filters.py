"""Line dedup (op3), decontamination (op7), secret scans (op9), substring dedup (op10)."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwright.llm import decontaminate, line_dedup, secret_scan, substring_dedup
from tests.llm.helpers import awkward, kept_lines, key, lines, marked_words, prose, repeated_words, table


def pairs(rows):
    return [(i, t) for i, t, _ in rows]


def test_line_dedup_equals_brute_force(spark):
    rows = pairs(awkward()) + [(20 + k, lines(30 + k % 3, 5) + "\n" + lines(5, 8)) for k in range(12)]
    docs = table(spark, rows)
    out = line_dedup.drop_repeated_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    # Equal ids with different texts go by a hash, so they are compared apart.
    apart = [r for r in rows if r[0] != 5]
    want = sorted(zip([i for i, _ in apart], kept_lines(apart), strict=True), key=key)
    alone = [g for g in got if g[0] != 5]
    assert alone == want


def test_line_dedup_counts_and_empty_table(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (5, "a\nb")]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(table(spark, rows)).collect()}
    assert [(got[k]["n_lines"], got[k]["n_removed"]) for k in range(1, 6)] == [(4, 0), (4, 3), (0, 0), (1, 0), (2, 0)]
    assert got[2]["text"] == "x\n"
    assert got[3]["text"] is None
    assert line_dedup.drop_repeated_lines(table(spark, [])).count() == 0


def test_line_dedup_has_no_python_in_its_plan(spark):
    plan = line_dedup.drop_repeated_lines(table(spark, awkward()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_fm_index_finds_every_occurrence(runs, n):
    text = np.array([x for r in runs for x in (*r, 0)], np.int64)
    index = decontaminate.FMIndex(text, 3)
    grams = {tuple(text[i : i + n].tolist()) for i in range(len(text) - n + 1)} | {(1,) * n, (3,) * n}
    table = np.array([g for g in grams if 0 not in g] or [(1,) * n], np.int64)
    low, high = index.search(table)
    for p, a, b in zip(table.tolist(), low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [(1, prose(2, 30)), (2, "One word"), (3, None), (4, "  "), (None, prose(77, 12)), (5, prose(2, 15)), (5, prose(2, 15))]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 200])
def test_decontamination_equals_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk_bytes)
    rows = pairs(awkward()) + [
        (30, "start " + prose(2, 30).upper() + " middle, " + prose(2, 9) + " ONE-WORD! end"),
        (31, prose(2, 9)),
        (32, "x. " * 30 + prose(77, 12)),
    ]
    out = decontaminate.decontaminate(table(spark, rows), bench(spark, ITEMS)).collect()
    got = sorted(
        (
            (r["doc_id"], r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"])
            for r in out
        ),
        key=key,
    )
    assert got == sorted(marked_words(rows, ITEMS), key=key)
    for r in out:
        text = dict(rows[-3:]).get(r["doc_id"])
        if text:
            spans = [(s["start"], s["end"]) for s in r["contamination"]["spans"]]
            assert r["text"] == decontaminate.without(text, spans)
            assert len(decontaminate.words_of(r["text"])) == r["contamination"]["n_words"] - r["contamination"]["n_hit"]
    assert {r["doc_id"]: r["text"] for r in out}[2] is None


def test_decontamination_of_empty_tables(spark):
    assert decontaminate.decontaminate(table(spark, []), bench(spark, ITEMS)).count() == 0
    out = decontaminate.decontaminate(table(spark, awkward()), bench(spark, [])).collect()
    assert len(out) == len(awkward())
    assert not any(r["contamination"]["n_hit"] for r in out)


SECRETS = [
    (1, 'password = "abcdefghijkl" and API-KEY: nothing, api_key=ABCDEFGHIJKLMNOP'),
    (2, None),
    (3, ""),
    (4, "AKIAABCDEFGHIJKLMN AKIAabc AKIA12 deadbeefdeadbeef deadbeef"),
    (5, "🙂 Secret:  'x1234567890./+=_-' 0123456789abcdef0"),
    (5, "token=short password=token:abcdefghijklmnop"),
    (6, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-1234567890ab passwd:" + "z" * 5000),
    (7, prose(9, 3000)),
    (None, "APIKEY='aaaaaaaaaaaaaaaa' toKen : bbbbbbbbbbbb"),
]


def plain_spans(text, rules):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]


def test_secrets_equal_a_full_scan(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD_BYTES", 100)
    got = secret_scan.scan(table(spark, SECRETS)).collect()
    mine = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in got), key=key)
    assert mine == sorted(((i, plain_spans(t, secret_scan.RULES)) for i, t in SECRETS), key=key)
    assert sum(len(s) for _, s in mine) >= 10
    assert secret_scan.scan(table(spark, [])).count() == 0


def test_base_rules_equal_their_stated_form():
    text = " ".join(t for _, t in SECRETS if t)
    hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert [(a, b) for k, a, b in plain_spans(text, secret_scan.BASE) if k == "hex"] == hexes


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]+") is None
    assert secret_scan.trigram_query(r"(foo|b)x*") is None
    assert secret_scan.trigram_query(r"(?i:Abcd)") == ("and", ("abc", "bcd"))
    assert secret_scan.trigrams_of(secret_scan.trigram_query(r"ab(c|d)f")) == {"abc", "abd", "bcf", "bdf"}
    index = secret_scan.ShardIndex(["xx ABC", "", "abd", "bcd abc"], ["abc", "bcd", "abd"])
    assert index.find("abc").tolist() == [0, 3]
    assert index.find(("and", ("abc", "bcd"))).tolist() == [3]
    assert index.find(("or", ("abd", "bcd"))).tolist() == [2, 3]
    assert index.find(None).tolist() == [0, 1, 2, 3]


@settings(max_examples=200, deadline=None)
@given(st.text("abcxk_-=", max_size=30))
def test_queries_never_lose_a_match(text):
    for pattern in (r"ab+c", r"(abc|xk?_)a{2,3}b", r"a[bc]x", r"(?:ab){2}c?k", r"x(a|b|c)*k=", r"a.b-", r"^abc|kk"):
        query = secret_scan.trigram_query(pattern)
        if re.search(pattern, text):
            index = secret_scan.ShardIndex([text], sorted(secret_scan.trigrams_of(query)))
            assert index.find(query).tolist() == [0], pattern


@pytest.mark.parametrize("subtree", [20_000, 1])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, subtree):
    monkeypatch.setattr(substring_dedup, "COUNTED_SHARE", 1)
    shared = prose(500, 60)
    rows = pairs(awkward()) + [
        (40 + k, prose(600 + k, 30) + " " + shared + " " + prose(700 + k, 20 + k % 3)) for k in range(15)
    ]
    rows += [(60, shared + " " + shared), (61, prose(500, 49)), (62, "  " + prose(500, 50, "\n\t") + "\n")]
    got = substring_dedup.remove_repeats(table(spark, rows), subtree=subtree).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=key)
    assert mine == sorted(repeated_words(rows), key=key)


def test_substring_dedup_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 50)
    rows = [(k % 9, " ".join(str((k * j) % 5) for j in range(40))) for k in range(30)]
    got = substring_dedup.remove_repeats(table(spark, rows).repartition(4), window=7, gram=3).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=key)
    assert mine == sorted(repeated_words(rows, 7), key=key)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
