"""Token ids, token files (op4) and packing (op2)."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabwright.llm import packing, token_files
from tabwright.llm.tokens import Encoder, default_tokenizer
from tests.llm.helpers import awkward, crc, key, prose, table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [
    "", " ", "a b", "a  b", "a\nb", "a\n\nb\n", "x \t y", "it's don't 'll a's", " x y", "word. word, w.. a1, 12. 3.5",
    "<|endoftext|> a", "hello<|endoftext|>", "é ñ ß 漢字 かな 🙂 x", "a\x1cb c", "a \x1cb", "'s x 's\n's", "end.\nStart",
    "x" * 300 + " yy", "\r\n a\r\n b", "a ", "\na", "a.b,c a, b. .", "A,\nB.\n, .", "a b  c", "1 22 333\n4",
]


def test_encoder_equals_the_library(tokenizer):
    enc = Encoder(default_tokenizer())
    texts = TEXTS + [prose(k, 50) for k in range(20)] + TEXTS
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_encoder_forgets_and_goes_on(tokenizer, monkeypatch):
    monkeypatch.setattr("tabwright.llm.tokens.MEMO", 10)
    enc = Encoder(default_tokenizer())
    for k in range(4):
        t = [prose(k, 40)]
        assert np.frombuffer(enc.encode(t)[0], enc.dtype).tolist() == tokenizer.encode(t[0]).ids


@pytest.mark.parametrize("frame_bytes", [16, 1 << 18])
def test_token_files_round_trip(spark, tokenizer, frame_bytes):
    rows = awkward()
    manifest = token_files.write_token_files(table(spark, rows), frame_bytes=frame_bytes)
    got = token_files.read_token_files(spark, manifest).collect()
    got.sort(key=lambda r: r["start"])
    ids = [(i, plain_ids(tokenizer, t)) for i, t, _ in rows]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["ids_crc32"] == crc(np.frombuffer(r["ids"], "<u4"))
    want = sorted(((i, len(x), crc(x)) for i, x in ids), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want
    some = token_files.read_token_files(spark, manifest, wanted=[7, 3, 99]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 7]
    assert {r["start"] for r in some} <= {r["start"] for r in got}


def test_token_files_of_an_empty_table(spark):
    manifest = token_files.write_token_files(table(spark, []))
    assert token_files.read_token_files(spark, manifest).count() == 0


def test_reader_reads_only_needed_frames_and_checks_them():
    out = io.BytesIO()
    w = token_files.Writer(out, np.dtype("<u2"), frame_bytes=64)
    docs = [np.arange(k, k + 10, dtype="<u2") for k in range(50)] + [np.arange(500, dtype="<u2")]
    for i, d in enumerate(docs):
        w.add(i, d.tobytes())
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()))
    assert r.ids(30).tolist() == docs[30].tolist()
    assert r.frames_read <= 2
    assert r.ids(50).tolist() == docs[50].tolist()
    assert [i for i, _ in r.find([4, 9])] == [4, 9]
    # Only skippable frames follow the data frames, so any zstandard reader reads the ids.
    assert struct.unpack("<I", out.getvalue()[-4:])[0] == token_files.END_MAGIC
    bad = bytearray(out.getvalue())
    bad[int(r.offsets[2]) + 12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(io.BytesIO(bytes(bad))).frame(2)


def check_pieces(rows, pieces, tokenizer, size):
    want = sorted(((i, tuple(plain_ids(tokenizer, t))) for i, t in rows), key=lambda x: key((x[0], len(x[1]), x[1][0])))
    by_doc = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    total = sum(len(x) for _, x in want)
    assert sum(p["length"] for p in pieces) == total
    for (i, n), own in by_doc.items():
        texts = [x for j, x in want if j == i and len(x) == n]
        # Rows that share id and length lie side by side: their pieces make whole texts.
        cover = np.zeros(n, int)
        for s, ids in own:
            cover[s : s + len(ids)] += 1
            assert any(tuple(ids) == x[s : s + len(ids)] for x in texts)
        assert (cover == len(texts)).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    return sequences


def test_packing_uses_every_token_once(spark, tokenizer):
    rows = awkward()
    for block in (1 << 20, 2000):
        got = packing.pack(table(spark, rows), sequence_tokens=128, block_tokens=block).collect()
        seqs = check_pieces([(i, t) for i, t, _ in rows], got, tokenizer, 128)
        fill = sorted(sum(n for _, n in s) for s in seqs.values())
        blocks = max(1, round(sum(fill) / block))
        assert sum(f < 128 for f in fill) <= blocks


def test_packing_follows_the_targets(spark, tokenizer):
    rows = [(k, prose(k, 200), "a" if k % 2 else "b") for k in range(60)]
    got = packing.pack(
        table(spark, rows), targets={"a": 3.0, "b": 1.0}, sequence_tokens=256, block_tokens=4000, least_piece=32
    ).collect()
    check_pieces([(i, t) for i, t, _ in rows], got, tokenizer, 256)
    total_a = sum(p["length"] for p in got if p["doc_id"] % 2)
    # Before the block in which "a" is drained each window has three quarters of it, up to the carried deficit.
    order = sorted({p["sequence_id"] for p in got})
    for s in order[: int(total_a / 0.75 / 256) - 17]:
        share = sum(p["length"] for p in got if p["sequence_id"] == s and p["doc_id"] % 2)
        assert abs(share - 0.75 * sum(p["length"] for p in got if p["sequence_id"] == s)) <= 80
    with pytest.raises(ValueError, match="missing"):
        packing.pack(table(spark, rows), targets={"a": 1.0})


def test_packing_of_an_empty_table(spark):
    assert packing.pack(table(spark, [])).count() == 0


def test_round_robin_fills_windows_and_bounds_deficits():
    sizes = np.array([5000, 300, 1, 2699])
    who, much = packing.deal(sizes, 100, 16)
    assert (np.bincount(who, much) == sizes).all()
    assert (np.flatnonzero(np.cumsum(much) % 100 == 0).size) == 80
    served = np.zeros(4)
    for k, n in zip(who, much, strict=True):
        served[k] += n
        assert (np.abs(served - sizes * served.sum() / 8000) <= 132).all()


def test_many_queues_are_dealt_like_few(monkeypatch):
    sizes = np.random.default_rng(4).integers(1, 500, 40)
    few = packing.deal(sizes, 100, 16)
    monkeypatch.setattr(packing, "FEW_QUEUES", 0)
    many = packing.deal(sizes, 100, 16)
    assert all((a == b).all() for a, b in zip(few, many, strict=True))


def test_schedule_blocks_partition_every_queue():
    plan = packing.Schedule(np.array([1000, 17, 50_000]), np.array([0.5, 0.3, 0.2]), 13)
    for s, n in enumerate(plan.tokens):
        at = np.arange(n)
        block = plan.block_of(np.full(n, s), at)
        assert (np.diff(block) >= 0).all()
        assert (plan.before(np.full(n, s), block) <= at).all()
        assert (plan.before(np.full(n, s), block + 1) > at).all()
