"""Removal of repeated byte strings: every byte covered by a ``length``-byte string that also starts in a document of smaller id.

All suffixes are compared to a depth of ``length`` bytes by blockwise bucket sorting over a difference cover. The cover holds residues of
places in a document, mod ``v = length - gram + 1``, such that any two places have a common offset below v at which both are in it:
five of 21. So two suffixes that agree in ``length`` bytes agree in some sample string, of ``gram`` bytes, at one offset in both.
Steps, each a pass over the texts, which are dealt by hash to chunks of about ``part_bytes``:

1. Sample strings of each chunk, sorted bucket by bucket: those of a single document can't repeat and are dropped.
2. Classes, which rank the sample: the class of a sample is the bytes of all suffixes that it stands for, those that start less
   than v before it. They are sorted bucket by bucket, ranked by smallest document. If a document smaller than one's own has the class, all
   its suffixes repeat: long ties, such as whole copies, are resolved by these ranks, with no look at single suffixes.
3. Single suffixes of the first document of a class, where the sample string has several classes. ``rounds`` equal parts of their
   hashes are sorted one after another, and bucket by bucket, so disk is bounded as well as memory.
4. Bytes: what steps 2 and 3 found is marked in each text.

A chunk sends each string once, whatever its documents repeat, so no bucket gathers more rows of a string than there are chunks.
Step 1 compares 39 bits of hashes within a bucket of bounded size, where a chance agreement costs time alone. Classes are compared by another 63 among those of one sample
string, single suffixes by two hashes of 63 and 64 bits.

Defined results: a null or empty text has nothing to remove; strings never cross documents; equal ids (or a null id, which is
smaller than any) are not smaller than each other; repeated rows of one id keep what they share; a long text is read in pieces of
``PIECE`` bytes; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spidex.llm.common import cut, mix, powers, scratch, shuffle_files_removed, text_or_empty

LENGTH, GRAM, BATCH, PIECE, HELD = 50, 30, 1 << 20, 1 << 20, 1 << 21
PART_BYTES, LEAST_PARTS, ROUNDS = 8 << 20, 16, 2
NOBODY = -(1 << 63)
_EVEN = ~np.uint64(1)
_BYTE, _OTHER = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
_PERFECT = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues mod v of which every residue is a difference: as few as can be for some v, about 2 sqrt(v) for others."""
    step = max(1, round(v**0.5))
    return _PERFECT.get(v) or tuple(sorted({*range(min(step, v)), *range(0, v, step)}))


class Piece(NamedTuple):
    """Bytes of a document from ``at`` on; suffixes that start in [first, last) are this piece's."""

    id: int
    data: bytes
    at: int
    size: int
    first: int
    last: int


def pieces(id_: int, text: bytes, length: int, v: int):
    """A text as pieces, each with what its suffixes and their samples need on either side."""
    n = len(text)
    if n <= PIECE:
        yield Piece(id_, text, 0, n, 0, n)
        return
    for first in range(0, n, PIECE):
        last = min(n, first + PIECE)
        at = max(0, first - v + 1)
        yield Piece(id_, text[at : last + length + v], at, n, first, last)


class Sample:
    """The cover sample of some pieces. Places are in the joined bytes; ``low`` to ``last`` are the suffixes that a sample stands for."""

    def __init__(self, some: list[Piece], length: int = LENGTH, gram: int = GRAM):
        self.pieces, self.length, self.gram, self.v = some, length, gram, length - gram + 1
        sizes = np.array([len(x.data) + 1 for x in some], np.int64)
        self.ends = np.cumsum(sizes)
        self.shift = self.ends - sizes - np.array([x.at for x in some], np.int64)  # from a place in the document to one here
        self.ids = np.array([x.id for x in some], np.int64)
        self.data = np.frombuffer(b"\0".join([*(x.data for x in some), b""]), np.uint8)
        marked = np.zeros(len(self.data) + 1, bool)
        reach = max((x.last - x.first for x in some), default=0) + 3 * self.v
        tile = np.zeros(self.v, bool)
        tile[list(difference_cover(self.v))] = True
        tile = np.tile(tile, reach // self.v + 2)
        for x, shift in zip(some, self.shift.tolist()):
            if x.size >= length:
                stop = min(x.last + self.v, x.size - gram + 1)
                marked[shift + x.first : shift + stop] = tile[x.first % self.v : x.first % self.v + max(0, stop - x.first)]
        self.at = np.flatnonzero(marked)
        self.of = self.piece_of(self.at)
        self.prefix = self._prefix(self.data, _BYTE) if len(self.at) else None

    def piece_of(self, places: np.ndarray) -> np.ndarray:
        """The piece of each of some places, which are in order."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(places, self.ends), prepend=0))

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """low, last and high of all samples."""
        begin, end = self.shift, self.shift + np.array([x.size for x in self.pieces], np.int64)
        return np.maximum(self.at - self.v + 1, begin[self.of]), np.minimum(self.at, (end - self.length)[self.of]), np.minimum(self.at + self.length, end[self.of])

    low, last, high = (property(lambda self, k=k: self.bounds[k]) for k in range(3))

    @cached_property
    def own(self) -> np.ndarray:
        """Whether each place is the start of a suffix of its piece."""
        out = np.zeros(len(self.data) + 1, bool)
        for x, shift in zip(self.pieces, self.shift.tolist()):
            if x.size >= self.length:
                out[shift + x.first : shift + min(x.last, x.size - self.length + 1)] = True
        return out

    @staticmethod
    def _prefix(data: np.ndarray, table: np.ndarray) -> np.ndarray:
        up, _ = powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        values = np.take(table, data)
        values *= up[: len(data)]
        np.cumsum(values, out=out[1:])
        return out

    def _hash(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        _, down = powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def strings(self) -> np.ndarray:
        """The hash of each sample string, an even number."""
        return self._hash(self.at, self.at + self.gram, self.prefix) & _EVEN if len(self.at) else np.zeros(0, np.uint64)

    def classes(self, some: np.ndarray) -> np.ndarray:
        """The class of some samples, an even number."""
        if not len(some):
            return np.zeros(0, np.uint64)
        low, at, high = self.low[some], self.at[some], self.high[some]
        return mix(self._hash(low, high, self.prefix) + (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & _EVEN

    def reached(self, which: np.ndarray) -> np.ndarray:
        """Whether each place is a suffix that some of these samples, given in order, stand for."""
        n = len(self.own)
        a, b = _union(self.low[which], self.last[which] + 1)
        turns = np.diff(np.stack([a, b], axis=1).ravel(), prepend=0, append=n)
        return np.repeat(np.arange(len(turns)) % 2 > 0, turns)

    def suffixes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the strings that start at places, which are in order; the first is even."""
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        end = start + self.length
        # the second reads the bytes of these strings alone, joined
        opens = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        counts = np.diff(opens, append=len(start))
        low, high = start[opens], end[opens + counts - 1]
        joined = np.concatenate([self.data[x:y] for x, y in zip(low.tolist(), high.tolist())])
        at = start - np.repeat(low - np.cumsum(high - low) + (high - low), counts)
        return self._hash(start, end, self.prefix) & _EVEN, self._hash(at, at + self.length, self._prefix(joined, _OTHER))


def _sorted(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys: their first bits and the row are sorted as one number, which is faster than to sort rows."""
    n = len(keys)
    if n < 2:
        return np.arange(n)
    least = keys.min()
    bits, spread = (n - 1).bit_length(), int(keys.max() - least).bit_length()
    mask = np.uint64((1 << bits) - 1)
    both = (keys - least) << np.uint64(min(63, 64 - spread))
    both &= ~mask
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    both &= mask
    order = both.view(np.int64)
    there = keys[order]
    # other keys may have the same first bits
    return order if (there[1:] >= there[:-1]).all() else np.argsort(keys, kind="stable")


def _order(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by several keys; those after the first are sorted only where they differ among equals of it."""
    order = _sorted(first)
    if not more or not len(order):
        return order
    same = np.append(False, first[order[1:]] == first[order[:-1]])
    differ = same.copy()
    differ[1:] &= np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in more])
    if differ.any():
        group = np.cumsum(~same) - 1
        some = np.flatnonzero(np.bincount(group[differ], minlength=group[-1] + 1)[group])
        rows = order[some]
        order[some] = rows[np.lexsort((*(k[rows] for k in more[::-1]), first[rows]))]
    return order


class _Lookup:
    """A table of hashes, by some of their bits. Most keys that aren't in it are told by one of these, without a look at the table."""

    def __init__(self, table: np.ndarray):
        self.mask = np.uint64((1 << max(10, min(26, (8 * len(table)).bit_length()))) - 1)
        place = self.place(table)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[place] = True
        self.rows = _sorted(place)
        self.table = table[self.rows]
        # a slot is four places, so rows in order of places are in order of slots
        self.start = np.zeros((int(self.mask) >> 2) + 2, np.int32)
        np.cumsum(np.bincount(self.slot(place), minlength=len(self.start) - 1), out=self.start[1:])

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(1)) & self.mask

    def slot(self, place: np.ndarray) -> np.ndarray:
        return (place >> np.uint64(2)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the table, in order, and in which row."""
        place = self.place(keys)
        some = np.flatnonzero(self.bits[place])
        keys, slot = keys[some], self.slot(place[some])
        at, end = self.start[slot], self.start[slot + 1]
        found = np.full(len(some), -1, np.int64)
        live = np.arange(len(some))
        while len(live):
            here = at[live]
            same = self.table[here] == keys[live]
            found[live[same]] = here[same]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        here = np.flatnonzero(found >= 0)
        return some[here], self.rows[found[here]]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(keys: np.ndarray) -> bytes:
    """The last five bytes of each hash: among the strings of one bucket, whose number has a bound, they seldom agree by chance."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_short(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _packed(rows: np.ndarray) -> bytes:
    """Hashes and, last, ids of some rows, column by column; ids byte by byte of all rows, so that compression takes their zeros."""
    ids = np.ascontiguousarray(rows[:, -1]).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(rows[:, :-1].T).tobytes() + np.ascontiguousarray(ids.T).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    n = len(data) // (8 * width)
    out = np.empty((n, width), np.uint64)
    out[:, :-1] = np.frombuffer(data, np.uint64, n * (width - 1)).reshape(width - 1, n).T
    out[:, -1] = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8 * n * (width - 1)).reshape(8, n).T).view("<u8")[:, 0]
    return out


def _blobs(rows: np.ndarray, keys: np.ndarray, chunk: int, buckets: int, packed=_packed):
    """A batch of (bucket, chunk, blob) for rows sorted by keys."""
    cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
    some = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    columns = [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int32()), pa.array([packed(rows[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "blob"])


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows in order differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class _Least:
    """Distinct keys (one or two hashes) with the smallest id of each, and whether several ids have it; compact however often a key comes."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: list[np.ndarray], ids: np.ndarray, several: np.ndarray | None = None) -> None:
        self.held.append([*keys, ids, np.zeros(len(ids), bool) if several is None else several])
        self.size += len(ids)
        if self.size > HELD and len(self.held) > 1:
            self.compact()
            if self.size > HELD // 2:  # all are distinct: wait for as many again
                self.size = 0

    def compact(self) -> list[np.ndarray]:
        *keys, ids, several = (np.concatenate(c) for c in zip(*self.held))
        order = _order(*keys)
        keys, ids, several = [k[order] for k in keys], ids[order], several[order]
        first = _edges(keys) if len(ids) else np.zeros(0, np.int64)
        least = ids
        if len(first):
            least = np.minimum.reduceat(ids, first)
            several = np.logical_or.reduceat(several, first) | (least != np.maximum.reduceat(ids, first))
        self.held = [[*(k[first] for k in keys), least, several]]
        self.size = len(first)
        return self.held[0]


def _by_chunk(work, length: int, v: int):
    """Runs work(chunk, marks of kind 0, 1, 2) for each chunk of rows sorted by (chunk, kind): feeds it lists of pieces, yields what it gives."""

    def run(batches_):
        job, chunk, marks, held, size = None, None, None, [], 0

        def fed():
            out = job.feed(held) if held else None
            return [out] if out is not None else []

        for batch in batches_:
            for k, kind, doc_id, text, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist()):
                if k != chunk:
                    if job is not None:
                        yield from fed()
                        yield from job.end()
                    job, chunk, marks, held, size = None, k, ([], [], []), [], 0
                if kind < 3:
                    marks[kind].append(blob)
                    continue
                if job is None:
                    job = work(chunk, marks)
                for piece in pieces(NOBODY if doc_id is None else doc_id, text, length, v):
                    if held and size + len(piece.data) > BATCH:
                        yield from fed()
                        held, size = [], 0
                    held.append(piece)
                    size += len(piece.data)
        if job is not None:
            yield from fed()
            yield from job.end()

    return run


def _table(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of several blobs."""
    return np.concatenate([np.zeros((0, width), np.uint64), *(_unpacked(b, width) for b in blobs)])


class _Strings:
    """Step 1: the sample strings of a chunk."""

    def __init__(self, chunk, marks, buckets, length, gram):
        self.chunk, self.buckets, self.how, self.least = chunk, buckets, (length, gram), _Least()

    def feed(self, some):
        sample = Sample(some, *self.how)
        self.least.add([sample.strings()], sample.ids[sample.of])

    def rows(self, keys, ids, several):
        return _blobs(keys[0] | several, keys[0], self.chunk, self.buckets, _short)

    def end(self):
        *keys, ids, several = self.least.compact()
        if len(ids):
            yield self.rows(keys, ids, several.astype(np.uint64))


class _Classes(_Strings):
    """Step 2: classes of the sample strings that several documents have."""

    def __init__(self, chunk, marks, *how):
        super().__init__(chunk, marks, *how)
        self.shared = _Lookup(np.concatenate([np.zeros(0, np.uint64), *(_from_short(b[8:]) | np.uint64(int.from_bytes(b[:8], "little") << 40) for b in marks[0])]))

    def feed(self, some):
        sample = Sample(some, *self.how)
        strings = sample.strings()
        placed = _bucket(strings, self.buckets) << np.uint64(40) | strings & np.uint64((1 << 40) - 1)
        known, _ = self.shared.find(placed)
        self.least.add([strings[known], sample.classes(known)], sample.ids[sample.of[known]])

    def rows(self, keys, ids, several):
        rows = np.stack([keys[0], keys[1] | several, ids.view(np.uint64)], axis=1)
        return _blobs(rows, keys[0], self.chunk, self.buckets, lambda rows: _short(rows[:, 0]) + _packed(rows[:, 1:]))


class _Suffixes(_Strings):
    """Step 3: single suffixes of first documents of classes whose sample string has several; those of one part of all hashes."""

    def __init__(self, chunk, marks, buckets, length, gram, part=0, parts=1):
        super().__init__(chunk, marks, buckets, length, gram)
        table = _table(marks[1], 2)
        self.known, self.least_of = _Lookup(table[:, 0] & _EVEN), np.ascontiguousarray(table[:, 1]).view(np.int64)
        self.several, self.part, self.parts = (table[:, 0] & ~_EVEN) > 0, np.uint64(part), np.uint64(parts)

    def resolved(self, sample) -> tuple[np.ndarray, np.ndarray]:
        """Samples all whose suffixes repeat; and places of suffixes that are looked at one by one."""
        some, at = self.known.find(sample.classes(np.arange(len(sample.at))))
        if not len(some):
            return some, some
        later = sample.ids[sample.of[some]] > self.least_of[at]
        gone, open_ = some[later], some[self.several[at]]
        return gone, np.flatnonzero(sample.reached(open_) & ~sample.reached(gone) & sample.own)

    def feed(self, some):
        sample = Sample(some, *self.how)
        _, start = self.resolved(sample)
        first, second = sample.suffixes(start)
        mine = (first >> np.uint64(1)) % self.parts == self.part
        self.least.add([first[mine], second[mine]], sample.ids[sample.piece_of(start[mine])])

    def rows(self, keys, ids, several):
        return _blobs(np.stack([keys[0] | several, keys[1], ids.view(np.uint64)], axis=1), keys[0], self.chunk, self.buckets, _packed)


class _Bytes(_Suffixes):
    """Step 4: the bytes to remove."""

    def __init__(self, chunk, marks, *how):
        super().__init__(chunk, marks, *how)
        table = _table(marks[2], 3)
        self.first, self.second, self.first_of = _Lookup(table[:, 0]), np.ascontiguousarray(table[:, 1]), np.ascontiguousarray(table[:, 2]).view(np.int64)
        self.long: list = []  # of a text in several pieces: its pieces' own bytes and spans so far

    def spans(self, sample) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of what goes, apart from each other and in order."""
        gone, start = self.resolved(sample)
        if len(start):
            first, second = sample.suffixes(start)
            some, at = self.first.find(first)
            ids = sample.ids[sample.piece_of(start[some])]
            start = start[some[(self.second[at] == second[some]) & (ids > self.first_of[at])]]
        return _union(np.concatenate([sample.low[gone], start]), np.concatenate([sample.last[gone], start]) + sample.length)

    def feed(self, some):
        sample = Sample(some, *self.how)
        a, b = self.spans(sample)
        cuts = np.searchsorted(a, [0, *sample.ends.tolist()])
        rows = []
        for k, x in enumerate(some):
            own = slice(cuts[k], cuts[k + 1])
            found = a[own] - sample.shift[k], b[own] - sample.shift[k]
            if x.at == 0 and x.last == x.size:
                rows.append(_cut_out(x.id, [x.data], x.size, *found))
                continue
            self.long.append((x.data[x.first - x.at : x.last - x.at], *found))
            if x.last == x.size:
                parts, first, last = zip(*self.long)
                rows.append(_cut_out(x.id, parts, x.size, *_union(np.concatenate(first), np.concatenate(last))))
                self.long = []
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
        columns = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    def end(self):
        return ()


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that cover the same as [a, b) of each pair; neighbours that touch are one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    opens = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    return a[opens], reach[np.append(opens[1:], len(a)) - 1]


def _cut_out(id_: int, parts, size: int, a: np.ndarray, b: np.ndarray) -> tuple:
    """A row of the result; the text is given in parts."""
    text = memoryview(parts[0] if len(parts) == 1 else b"".join(parts))
    seal, since = hashlib.sha256(), 0
    for x, y in zip(a.tolist(), b.tolist()):
        seal.update(text[since:x])
        since = y
    seal.update(text[since:])
    spans = [{"start": x, "length": y - x} for x, y in zip(a.tolist(), b.tolist())]
    return None if id_ == NOBODY else id_, size, int((b - a).sum()), len(a), seal.hexdigest(), spans


def _by_bucket(resolve):
    """Runs resolve(bucket, chunks, arrays) for each bucket of rows (bucket, chunk, blob) sorted by bucket: it gives (chunk, bytes) to send back."""

    def run(batches_):
        bucket, chunks, blobs = None, [], []

        def done():
            back = [(c, b) for c, b in resolve(bucket, chunks, blobs) if b]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in back], pa.int32()), pa.array([b for _, b in back], pa.binary())], names=["chunk", "blob"])

        for batch in batches_:
            for k, c, b in zip(*(batch.column(x).to_pylist() for x in range(3))):
                if k != bucket:
                    if blobs:
                        yield done()
                    bucket, chunks, blobs = k, [], []
                chunks.append(c)
                blobs.append(b)
        if blobs:
            yield done()

    return run


def _back(chunks, rows, of, packed=_packed):
    cuts = np.searchsorted(of, np.arange(len(chunks) + 1))
    return [(c, packed(rows[cuts[k] : cuts[k + 1]])) for k, c in enumerate(chunks)]


def _shared(bucket, chunks, blobs):
    """Step 1: to each chunk those of its strings that another document has."""
    rows, of = _from_short(b"".join(blobs)), np.repeat(np.arange(len(blobs)), [len(b) // 5 for b in blobs])
    keys = rows & _EVEN
    order = _sorted(rows)  # the last bit tells apart what several documents of a chunk have
    first = _edges([keys[order]])
    n = np.diff(first, append=len(rows))
    several = (n > 1) | ((rows[order[first + n - 1]] & ~_EVEN) > 0)
    some = np.empty(len(rows), bool)
    some[order] = np.repeat(several, n)
    return [(c, bucket.to_bytes(8, "little") + b) for c, b in _back(chunks, keys[some], of[some], _short) if b]


def _ranked(bucket, chunks, blobs):
    """Step 2: to each chunk (class, its smallest document, whether its sample string has others) where that matters."""
    n = [len(b) // 21 for b in blobs]
    strings = np.concatenate([_from_short(b[: 5 * k]) for b, k in zip(blobs, n)])
    rows, of = np.concatenate([_unpacked(b[5 * k :], 2) for b, k in zip(blobs, n)]), np.repeat(np.arange(len(blobs)), n)
    classes, ids = rows[:, 0] & _EVEN, np.ascontiguousarray(rows[:, 1]).view(np.int64)
    order = _order(strings, classes)
    string_edges, class_edges = _edges([strings[order]]), _edges([strings[order], classes[order]])
    sizes = np.diff(np.append(class_edges, len(rows)))
    of_string = np.searchsorted(string_edges, class_edges, side="right") - 1
    others = np.bincount(of_string, minlength=len(string_edges)) > 1
    several, least = np.empty(len(rows), bool), np.empty(len(rows), np.int64)
    several[order], least[order] = np.repeat(others[of_string], sizes), np.repeat(np.minimum.reduceat(ids[order], class_edges), sizes)
    some = several | (least < ids) | ((rows[:, 0] & ~_EVEN) > 0)
    return _back(chunks, np.stack([classes[some] | several[some].astype(np.uint64), least[some].view(np.uint64)], axis=1), of[some])


def _first(bucket, chunks, blobs):
    """Step 3: to each chunk the smallest document of each suffix, where it isn't the chunk's only one."""
    rows = np.concatenate([_unpacked(b, 3) for b in blobs])
    of = np.repeat(np.arange(len(blobs)), [len(b) // 24 for b in blobs])
    first, second, ids = rows[:, 0] & _EVEN, rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.int64)
    order = _order(first, second)
    edges = _edges([first[order], second[order]])
    least = np.empty(len(rows), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], edges), np.diff(np.append(edges, len(rows))))
    some = (least < ids) | ((rows[:, 0] & ~_EVEN) > 0)
    return _back(chunks, np.stack([first[some], second[some], least[some].view(np.uint64)], axis=1), of[some])


def repeats(docs: DataFrame, write_to, length: int = LENGTH, gram: int = GRAM, part_bytes: int = PART_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document; marks are tables at write_to(name), needed until the result is read."""
    spark = docs.sparkSession
    if not 0 < gram <= length:
        raise ValueError("the sample strings must not be longer than the strings")
    v = length - gram + 1
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # a chunk and a bucket are a task's share each, whatever the input's size
    parts = buckets = max(LEAST_PARTS, -(-total // part_bytes))
    columns = "chunk int, kind int, doc_id long, text string, blob binary"
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()), F.lit(parts)).cast("int")
    texts = docs.select(chunk.alias("chunk"), F.lit(3).alias("kind"), F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.lit(None).cast("binary").alias("blob"))

    def dealt(*marks: tuple[int, str]) -> DataFrame:
        rows = texts
        for kind, name in marks:
            rows = rows.unionByName(spark.read.schema("chunk int, blob binary").parquet(write_to(name)).select("chunk", F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob"))
        rows = rows.select(*(c.split()[0] for c in columns.split(", ")))
        return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")

    def step(job, resolve, name: str, *marks, more: tuple = ()) -> None:
        sent = dealt(*marks).mapInArrow(_by_chunk(lambda chunk, held: job(chunk, held, buckets, length, gram, *more), length, v), "bucket int, chunk int, blob binary")
        back = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(resolve), "chunk int, blob binary")
        back.write.parquet(write_to(name))

    step(_Strings, _shared, "strings")
    step(_Classes, _ranked, "classes", (0, "strings"))
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(write_to("strings"))
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    for k in range(rounds):
        step(_Suffixes, _first, f"suffixes{k}", (1, "classes"), more=(k, rounds))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,length:bigint>>"
    found = dealt((1, "classes"), *((2, f"suffixes{k}") for k in range(rounds)))
    return found.mapInArrow(_by_chunk(lambda chunk, held: _Bytes(chunk, held, buckets, length, gram), length, v), schema)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **how) -> DataFrame:
    """repeats() without anything left behind; the result is a checkpoint of its own."""
    spark = docs.sparkSession
    with scratch(spark) as path, shuffle_files_removed(spark):
        return cut(repeats(docs, path, length, gram, **how))


#: What op3's query returns in DuckDB's SQL, from every string of 50 bytes.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS s FROM d),
g AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS string FROM w),
first AS (SELECT string, min(doc_id) AS least FROM g GROUP BY string HAVING count(*) > 1),
later AS (SELECT DISTINCT doc_id, s FROM g JOIN first USING (string) WHERE doc_id > least),
turn AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM later),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM turn),
span AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept, max(b) AS tail
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
