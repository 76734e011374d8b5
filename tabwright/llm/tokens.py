"""Token ids of whole texts with the ``tokenizers`` library, one Arrow batch at a time.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, so a text may
be cut before any blank or line break that stands alone and each part encoded once.
``Encoder`` keeps the ids of parts it has seen (``MEMO`` entries at most, then it starts
anew). Tasks that encode keep the memo for the next ones; those of other operators empty it
(``common.tidy``). Texts with other white space, or tokenizers of another kind, are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

# About 220 bytes each: a part's text, its ids and its place in the memo.
MEMO = 1_200_000
LONG_PART = 48
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        # The vocabulary's size decides the width of stored ids.
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        pre = spec.get("pre_tokenizer") or {}
        self.in_parts = (
            spec["model"].get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.spaced: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes | None] = {}
        self.stops = {c: self._whole([c])[0] for c in ".,"}
        self.line_break = self._whole(["\n"])[0]
        # Tokens that begin with a blank (written so in byte-level vocabularies).
        self.after_blank = np.zeros(top + 1, bool)
        self.after_blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _plain(self, t: str) -> bool:
        """Blanks and line breaks stand alone, and no added token's text occurs."""
        return not (
            "  " in t
            or "\n\n" in t
            or " \n" in t
            or "\n " in t
            or t[0] in " \n"
            or t[-1] in " \n"
            or any(a in t for a in self.added)
        )

    def _learn(self, parts: set[str], memo: dict[str, bytes | None], lead: str) -> None:
        fresh: dict[str, str] = {}
        for p in parts.difference(memo):
            if p.split() != [p]:
                memo[p] = None  # other white space: such texts are encoded whole
            elif len(p) > 1 and p[-1] in ".," and (word := p[:-1]).isalpha():
                fresh[p] = word
            else:
                fresh[p] = p
        words = list(set(fresh.values()).difference(memo))
        if words:
            ids, starts = self._parts(words, lead)
            raw, size = ids.tobytes(), self.dtype.itemsize
            places = [*(starts * size).tolist(), len(raw)]
            gap = 0 if lead else len(self.line_break)
            places[-1] += gap
            for w, start, end in zip(words, places, places[1:], strict=False):
                memo[w] = raw[start : end - gap]
        for p, w in fresh.items():
            if p != w:
                memo[p] = memo[w] + self.stops[p[-1]]

    def _parts(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a blank each, or stand on lines of their own, and where each starts."""
        joined = lead + " ".join(words) if lead else "\n".join(words)
        ids = np.frombuffer(self._whole([joined])[0], self.dtype)
        if lead:
            starts = np.flatnonzero(self.after_blank[ids])
        else:
            stops = np.flatnonzero(ids == np.frombuffer(self.line_break, self.dtype)[0])
            starts = np.concatenate([[0], stops + 1])
        if len(starts) != len(words):
            raise ValueError("the vocabulary has tokens across white space")
        return ids, starts

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        if not self.in_parts:
            return self._whole(texts)
        if len(self.spaced) + len(self.bare) > MEMO:
            self.spaced.clear()
            self.bare.clear()
        split: list[list[list[str]] | None] = []
        spaced: set[str] = set()
        bare: set[str] = set()
        for t in texts:
            if not t:
                split.append([])
            elif self._plain(t):
                lines = [x.split(" ") for x in t.split("\n")]
                for x in lines:
                    bare.add(x[0])
                    spaced.update(x[1:])
                split.append(lines)
            else:
                split.append(None)
        self._learn(spaced, self.spaced, " ")
        self._learn(bare, self.bare, "")
        out: list[bytes | None] = []
        after = self.spaced.__getitem__
        for lines in split:
            if lines is None:
                out.append(None)
                continue
            try:
                out.append(self.line_break.join([b"".join([self.bare[x[0]], *map(after, x[1:])]) for x in lines]))
            except TypeError:  # a part holds other white space
                out.append(None)
        for memo, found in ((self.spaced, spaced), (self.bare, bare)):
            for p in [p for p in found if len(p) > LONG_PART]:
                del memo[p]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
                out[i] = x
        return out


def forget() -> None:
    """Empty the memos of the process's encoders."""
    for e in _encoders.values():
        e.spaced, e.bare = {}, {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file: made once, kept over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_type(path: str) -> np.dtype:
    return encoder(path).dtype
