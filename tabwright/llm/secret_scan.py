"""Find secrets with rules given as regular expressions, through a trigram inverted index.

From each rule a Boolean query over trigrams is derived that every match must satisfy.
Texts are indexed shard by shard (a shard is what a task holds at once): for every trigram
that some rule asks for, the sorted list of the shard's documents that contain it. A rule's
query intersects and unites these postings, and only the documents found are verified with
the expression itself. Rules without a mandatory trigram are verified on every document.
The index is over texts with A-Z in lower case, so it serves rules of either kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SHARD_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so asking for 16 at once equals dropping the shorter ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Public token formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE

# A query is None (every document), a trigram, or ("and" | "or", parts).
Query = None | str | tuple
MAX_STRINGS = 64
MAX_CHARS = 4


@dataclass
class Facts:
    """What is known of the strings an expression matches.

    ``exact``: all of them, or None. Else sets one of which each begins or ends with.
    """

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query = None


NOTHING = frozenset({""})


def _join(kind: str, parts: Sequence[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    flat = [q for p in parts if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == kind else (p,))]
    known = list(dict.fromkeys(flat))
    if not known:
        return None
    return known[0] if len(known) == 1 else (kind, tuple(known))


def _one_of(strings: frozenset[str]) -> Query:
    # Only ASCII trigrams are indexed; others are not mandatory.
    parts = [[t for i in range(len(s) - 2) if (t := s[i : i + 3]).isascii()] for s in sorted(strings)]
    return _join("or", [_join("and", p) for p in parts])


def _low(value: int) -> str:
    """A character in lower case as the texts are: ASCII only."""
    return chr(value).lower() if value < 128 else chr(value)


def _loose(f: Facts) -> Facts:
    """Without the exact set: its trigrams go into the query."""
    if f.exact is None:
        return f
    return Facts(
        None,
        frozenset(s[:3] for s in f.exact),
        frozenset(s[-3:] for s in f.exact),
        _join("and", [f.query, _one_of(f.exact)]),
    )


def _crossed(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def _then(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_STRINGS:
        return Facts(_crossed(a.exact, b.exact), NOTHING, NOTHING, _join("and", [a.query, b.query]))
    prefix = a.exact if a.exact is not None else a.prefix
    suffix = b.exact if b.exact is not None else b.suffix
    border = _crossed(a.exact or a.suffix, b.exact or b.prefix)
    query = _join("and", [_loose(a).query, _loose(b).query, _one_of(border) if len(border) <= MAX_STRINGS else None])
    if a.exact is not None:
        prefix = _crossed(a.exact, b.exact or b.prefix)
    if b.exact is not None:
        suffix = _crossed(a.exact or a.suffix, b.exact)
    if len(prefix) > MAX_STRINGS:
        prefix = frozenset(s[:1] for s in prefix)
    if len(suffix) > MAX_STRINGS:
        suffix = frozenset(s[-1:] for s in suffix)
    return Facts(None, prefix, suffix, query)


def _either(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MAX_STRINGS:
        if a.query is None and b.query is None:
            return Facts(a.exact | b.exact, NOTHING, NOTHING)
    x, y = _loose(a), _loose(b)
    return Facts(None, x.prefix | y.prefix, x.suffix | y.suffix, _join("or", [x.query, y.query]))


def _any() -> Facts:
    return Facts(None, NOTHING, NOTHING)


def _chars(items: list) -> Facts:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(_low(value))
        elif op is C.RANGE and value[1] - value[0] < 2 * MAX_CHARS:
            found.update(_low(c) for c in range(value[0], value[1] + 1))
        else:
            return _any()
    return Facts(frozenset(found), NOTHING, NOTHING) if len(found) <= 2 * MAX_CHARS else _any()


def _facts(tree: Sequence) -> Facts:
    out = Facts(NOTHING, NOTHING, NOTHING)
    for op, value in tree:
        if op is C.LITERAL:
            part = Facts(frozenset({_low(value)}), NOTHING, NOTHING)
        elif op is C.IN:
            part = _chars(value)
        elif op is C.SUBPATTERN:
            part = _facts(value[3])
        elif op is C.BRANCH:
            part = reduce(_either, [_facts(x) for x in value[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _facts(inner)
            if (least, most) == (0, 1):
                part = _either(once, Facts(NOTHING, NOTHING, NOTHING))
            elif least == 0:
                part = _any()
            else:
                part = reduce(_then, [once] * min(least, 4))
                if most != least or least > 4:
                    loose = _loose(part)
                    part = Facts(None, loose.prefix, loose.suffix, loose.query)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = Facts(NOTHING, NOTHING, NOTHING)
        else:
            part = _any()
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """A query that every text with a match satisfies; None if nothing is mandatory."""
    f = _loose(_facts(_parser.parse(pattern)))
    return _join("and", [f.query, _one_of(f.prefix), _one_of(f.suffix)])


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class ShardIndex:
    """Postings of the wanted trigrams over the texts of one shard."""

    def __init__(self, texts: Sequence[str], wanted: Sequence[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.n = len(raw)
        ends = np.cumsum([len(x) + 1 for x in raw])
        # A zero byte parts the texts; no rule's trigram holds one.
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        codes = {int.from_bytes(t.encode(), "big"): t for t in wanted if len(t.encode()) == 3}
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(data) < 3:
            return
        # Few positions pass the test of the first byte pair, then the whole code is compared.
        pairs = np.zeros(1 << 16, bool)
        pairs[[c >> 8 for c in codes]] = True
        at = np.flatnonzero(pairs[(data[:-2].astype(np.uint16) << 8) | data[1:-1]])
        code = (data[at].astype(np.int32) << 16) | (data[at + 1].astype(np.int32) << 8) | data[at + 2]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        doc = np.searchsorted(ends, at, side="right")
        for c, t in codes.items():
            a, b = np.searchsorted(code, [c, c + 1])
            self.postings[t] = np.unique(doc[a:b])

    def find(self, query: Query) -> np.ndarray:
        """The documents that satisfy a query, in order."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(query, np.arange(self.n))
        parts = sorted((self.find(q) for q in query[1]), key=len)
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All matches of the rules in every text: ``doc_id`` and ``spans``.

    A span is ``(kind, start, end)`` in code points, end exclusive; per kind matches are
    leftmost and do not overlap, and spans are sorted by start, then by the rules' order.
    Null and empty texts, and texts without a match, have no spans; each input row gives
    one row, repeated ids included. No rows are shuffled.
    """
    ship(docs.sparkSession)
    rules = tuple(rules)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def shard(ids: pa.Array, texts: list[str], compiled: list[re.Pattern]) -> pa.RecordBatch:
        index = ShardIndex(texts, wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            for i in index.find(query).tolist():
                for m in compiled[k].finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
        return pa.RecordBatch.from_arrays([ids, pa.array(spans, span)], names=["doc_id", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= SHARD_BYTES or i + 1 == len(texts):
                    yield shard(b.column("doc_id").slice(start, i + 1 - start), texts[start : i + 1], compiled)
                    start, size = i + 1, 0

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
