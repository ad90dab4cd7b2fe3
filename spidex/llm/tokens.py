"""Byte-level BPE ids of whole texts, with the tokenizers library.

A text's pre-tokens are encoded independently, so each distinct one needs the library once. The
pre-tokens of a batch are found with numpy, hashed, and looked up in a bounded table; what is not there
goes through the library's BPE model. Texts that hold an added token's string go through the library whole.
"""

from __future__ import annotations

import os
import sys
import unicodedata

import numpy as np

from spidex.llm.common import prefix_hash, span_hash

_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK = 1, 2, 3, 4, 5
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_kinds: list[np.ndarray] = []


def _kind_of() -> np.ndarray:
    if not _kinds:
        kind = np.full(sys.maxunicode + 2, _OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            g = unicodedata.category(chr(c))[0]
            if g in "LN":
                kind[c] = _LETTER if g == "L" else _NUMBER
        kind[_WHITE] = _SPACE
        kind[sys.maxunicode + 1] = _BREAK
        _kinds.append(kind)
    return _kinds[0]


def _byte_chars() -> dict[int, str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """ids of texts, as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them."""

    SLOTS = 1 << 21

    def __init__(self, path: str, kept_ids: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chars = _byte_chars()
        self.kept_ids = kept_ids
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.count = np.zeros(self.SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _spans(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pre-tokens in code points, and the code points' kinds. Breaks are pre-tokens of their own."""
        kind = _kind_of()[c]
        n = len(c)
        begins = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
        runs = np.flatnonzero(begins)
        first, last = runs[:-1], runs[1:] - 1
        white = kind[first] == _SPACE
        follows = white & (runs[1:] < n) & (kind[np.minimum(runs[1:], n - 1)] != _BREAK)
        # the last white character before something is apart from those before it; a space joins what follows
        begins[last[follows]] = True
        begins[last[follows & (c[last] == 0x20)] + 1] = False
        quote = first[(kind[first] == _OTHER) & (first == last) & (c[first] == 0x27) & begins[first]]
        quote = quote[quote + 1 < n]
        quote = quote[kind[quote + 1] == _LETTER]
        if len(quote):
            a, b = c[quote + 1], c[np.minimum(quote + 2, n - 1)]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            two &= quote + 2 < n
            for found, length in ((one, 1), (two, 2)):
                q = quote[found]
                begins[q + 1] = False
                begins[q + 1 + length] = True
        begins[np.flatnonzero(kind == _BREAK)] = True
        return np.flatnonzero(begins[:n]), kind

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        rows = [[t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.chars))] for s in texts]
        counts = np.fromiter(map(len, rows), np.int32, len(rows))
        total = int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for r in rows for i in r), np.uint32, total)
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        self.key[slot], self.at[slot], self.count[slot] = keys, self.used + np.cumsum(counts) - counts, counts
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more entry than texts)."""
        special = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        c = np.frombuffer("".join([x for k, t in enumerate(texts) for x in ("" if k in special else t, "\0")]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        sizes = np.array([0 if k in special else len(t) for k, t in enumerate(texts)], np.int64)
        breaks = np.cumsum(sizes + 1) - 1
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        c[breaks] = sys.maxunicode + 1
        start, kind = self._spans(c)
        end = np.append(start[1:], len(c))
        real = kind[start] != _BREAK
        start, end = start[real], end[real]
        key = span_hash(prefix_hash(c), start, end)
        if self.used > self.kept_ids:
            self.clear()
        counts, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        while True:
            slot = (key[open_] & np.uint64(self.SLOTS - 1)).astype(np.int64)
            hit = (self.key[slot] == key[open_]) & (self.count[slot] > 0)
            counts[open_[hit]], at[open_[hit]] = self.count[slot[hit]], self.at[slot[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            # one key for each slot and turn: a later one takes the slot in the next turn
            _, one = np.unique(slot[~hit], return_index=True)
            new = open_[one]
            self._learn(key[new], [c[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[new].tolist(), end[new].tolist())])
        total = int(counts.sum())
        out_at = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(at - out_at, counts) + np.arange(total)]
        of = np.searchsorted(breaks, start)  # the text of each pre-token
        per = np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per)])
        if special:
            parts = [self.whole(t) if k in special else ids[bounds[k] : bounds[k + 1]] for k, t in enumerate(texts)]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(texts: list[str], units: int = 1 << 20):
    """Runs [a, b) of texts with about so many characters, one text at least."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > units:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
