"""Small tables with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, th string, score string, "
    "start int, `key` string, queue string, n_lines string, toxicity string, contamination string, fp string"
)


def prose(seed: int, words: int, sep: str = " ") -> str:
    rng = random.Random(seed)
    return sep.join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(words))


def lines(seed: int, n: int) -> str:
    return "\n".join(prose(seed * 1000 + i, 6) for i in range(n))


def table(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names operators use themselves."""
    full = []
    for r in rows:
        i, t, s = (*r, "a")[:3]
        full.append((i, t, "en", s, len(t) if t else 0, 1, "x", "y", 2, "k", "q", "l", "t", "c", "f"))
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    """Null, empty and blank texts, repeated rows and ids, a long text, null ids and sources."""
    long = prose(1, 6000)
    return [
        (1, long, "a"),
        (2, None, None),
        (3, "", "b"),
        (4, " \n\t ", "b"),
        (5, prose(2, 80), "a"),
        (5, prose(2, 80), "a"),
        (5, prose(3, 80), "c"),
        (6, prose(2, 80), None),
        (7, long + " tail", "a"),
        (8, "One Word", "a"),
        (None, prose(2, 80), "a"),
        (9, "é ñ 漢字 🙂 naïve " * 40, "d"),
        (10, "a\r\n\r\n b\x0bc  d e", "d"),
        (11, lines(5, 8), "a"),
        (12, lines(6, 3) + "\n" + lines(5, 8), "a"),
        (13, "same\n\n\nsame\nsame\nsame\n  same\nsame", "a"),
    ]


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_lines(rows, run=3):
    """Texts after repeated runs of lines are deleted, in the order of the rows."""
    split = re.compile(r"(?<=\n)(?=[^\S\n]*\S)", re.A)
    units = {}
    for i, t in rows:
        if t is not None:
            units[(i, t)] = [x for x in split.split(t)]
    order = sorted(units, key=lambda k: (k[0] is not None, k[0] or 0))
    seen, out = {}, {}
    for key in order:
        own = [u.strip(" \t\n\r\x0b\x0c") for u in units[key]]
        for s in range(len(own) - run + 1):
            seen.setdefault(tuple(own[s : s + run]), (key, s))
    for key in order:
        own = [u.strip(" \t\n\r\x0b\x0c") for u in units[key]]
        gone = set()
        for s in range(len(own) - run + 1):
            if seen[tuple(own[s : s + run])] != (key, s):
                gone.update(range(s, s + run))
        out[key] = "".join(u for k, u in enumerate(units[key]) if k not in gone)
    return [None if t is None else out[(i, t)] for i, t in rows]


def repeated_words(rows, window=50):
    first = {}
    for i, t in rows:
        w = SHINGLE_WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SHINGLE_WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def marked_words(docs, items, window=10):
    held = {}
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in held}
    out = []
    for i, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = held.get(tuple(w[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def key(x):
    """Sort key of rows that hold nulls."""
    return [(v is not None, str(type(v)), v if v is not None else 0) for v in x]
