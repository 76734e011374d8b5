"""Weak supervision (op1)."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tabwright.llm import toxicity
from tests.llm.helpers import awkward, prose, table


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def made(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        words = prose(seed * 10_000 + i, 60).split()
        if bad:
            for w in rng.sample(["idiot", "grumpf", "blarg", "snorkish", "vexuno", "vexuta"], 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_scored_right(spark):
    rows, labels = made(500)
    flipped = [(i, q, 1 - y if is_held(i) else y) for i, q, y in labels]
    out = [
        {r["doc_id"]: r for r in toxicity.score_documents(table(spark, rows), label_table(spark, x)).collect()}
        for x in (labels, flipped)
    ]
    held = [(i, y) for i, _, y in labels if is_held(i)]
    assert all(out[0][i]["held_out"] for i, _ in held)
    right = np.mean([out[0][i]["predicted"] == y for i, y in held])
    assert right >= 0.95
    # Held-out labels change nothing.
    assert all(out[0][i]["toxicity"] == pytest.approx(out[1][i]["toxicity"]) for i, _, _ in labels)


def test_awkward_rows_get_scores(spark):
    rows, labels = made(120, 3)
    odd = [(None if i is None else 10_000 + i, t) for i, t, _ in awkward()]
    labels += [(10_001, 1, None), (None, 1, 1), (5, 1, 1), (99_999, 0, 1)]
    docs = table(spark, rows + odd)
    out = toxicity.score_documents(docs, label_table(spark, labels))
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r["toxicity"] <= 1 and r["predicted"] == int(r["toxicity"] >= 0.5) for r in got)
    assert not any(r["predicted"] for r in got if not r["text"])
    assert len({r["toxicity"] for r in got if r["doc_id"] == 10_005}) <= 2


def test_tables_without_labels_or_rows(spark):
    rows, labels = made(30, 4)
    for given in ([], [(i, 1, 0) for i, _, _ in labels]):
        got = toxicity.score_documents(table(spark, rows), label_table(spark, given)).collect()
        assert len(got) == 30 and not any(r["predicted"] for r in got)
    assert toxicity.score_documents(table(spark, []), label_table(spark, labels)).count() == 0


def test_label_model_finds_accuracies_and_correlations(spark):
    rng = np.random.default_rng(5)
    n = 4000
    y = rng.random(n) < 0.2
    masks = np.zeros(n, np.int64)
    chance = {0: (0.6, 0.02), 1: (0.5, 0.02), 3: (0.4, 0.2)}
    for k, (a, b) in chance.items():
        masks |= (rng.random(n) < np.where(y, a, b)).astype(np.int64) << k
    masks |= (masks & 1) << 2  # a copy of the first voter
    values, counts = np.unique(masks, return_counts=True)
    patterns = spark.createDataFrame(list(zip(values.tolist(), counts.tolist(), strict=True)), "votes long, n long")
    start = np.full(toxicity.VOTERS, 0.5)
    start[:4] = 0.7, 0.7, 0.7, 0.5
    model = toxicity.fit_label_model(patterns, start, 0.3, 0.05)
    truth = [y[masks >> k & 1 == 1].mean() for k in range(4)]
    assert model.accuracy[:4] == pytest.approx(truth, abs=0.2)
    assert model.weight[0] < 0.7 and model.weight[2] < 0.7 < model.weight[1]
    assert ((model.posteriors(masks)[0] > 0.5) == y).mean() > 0.85
