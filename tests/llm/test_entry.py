"""The registered queries, their SQL and the pipeline."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabwright.llm.queries import QUERIES, SQL
from tabwright.session import cut_lineage
from tests.llm.helpers import awkward, kept_lines, marked_words, prose, table


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    toxic = [(500 + k, prose(900 + k, 40) + " idiot moron scum grumpf " + prose(950 + k, 10)) for k in range(12)]
    rows = [(i, t) for i, t, _ in awkward()] + toxic + [(600 + k, prose(2000 + k, 70)) for k in range(40)]
    rows += [(700, prose(3000, 40) + " " + prose(77, 12) + " " + prose(3001, 40)), (701, prose(2000, 70) + " more")]
    table(spark, rows).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(500 <= i < 600)) for i, _ in rows if i is not None and i >= 500]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 12))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def test_stages_of_the_pipeline(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, path))
        out[name] = (before, docs)
    assert list(out) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(d.columns == columns for n, (_, d) in out.items() if n != "packing")
    left = {r["doc_id"] for r in out["toxicity"][1].collect()}
    assert not left & set(range(500, 512))
    assert set(range(600, 640)) <= left and {2, 3, None} <= left
    before, after = ({(r["doc_id"], r["text"]) for r in d.collect() if r["doc_id"] != 5} for d in out["line_dedup"])
    mine = list(before)
    assert set(zip([i for i, _ in mine], kept_lines(mine), strict=True)) == after
    near = {r["doc_id"] for r in out["near_dedup"][1].collect()}
    assert 600 in near and 701 not in near and set(range(601, 640)) <= near
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in out["decontamination"])
    assert set(before) == set(after)
    assert [i for i in before if before[i] != after[i]] == [700]
    assert not any(n for _, _, n, _ in marked_words(after.items(), [(1, prose(77, 12))]))
    pieces = out["packing"][1].collect()
    assert {p["doc_id"] for p in pieces} == set(after)


def test_run_of_the_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert got.count() > 0
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(got.columns)
