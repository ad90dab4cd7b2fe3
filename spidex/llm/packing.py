"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing, exactly, at any size: documents of one length are alike, so the driver packs the
histogram of lengths (at most ``capacity`` rows) instead of documents. Open bins are kept as runs of bin
numbers under their remaining capacity, and a segment tree over the capacities finds the tightest one that
fits in O(log capacity). The outcome is a list of moves; each tells where a run of the documents of one length
goes. Its size depends on the capacity alone (below 200 * capacity moves), so it may be broadcast.

Defined results: null and empty texts are the end id alone; equal rows are packed each; ties between documents
of one length fall as their partitions do; an empty table packs to an empty table; columns of the input other than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.llm.common import cut, text_or_empty


class CapacityTree:
    """A segment tree over capacities 0..top that counts open runs; least(x) is the smallest open capacity >= x."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.width
        while k:
            self.open[k] += by
            k >>= 1

    def least(self, capacity: int) -> int | None:
        k = capacity + self.width
        if self.open[k]:
            return capacity
        while k > 1:
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Moves (length, first rank, documents, documents a bin, first bin, offset) by length and rank; number of bins."""
    tree, runs, moves, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(room: int, first: int, n: int, front: bool = False) -> None:
        if n and room:
            (runs[room].appendleft if front else runs[room].append)((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -1)
            each = min(room // length, left)
            full = min(n, left // each)
            moves.append((length, rank, full * each, each, first, capacity - room))
            put(room, first + full, n - full, front=True)
            put(room - each * length, first, full)
            left -= full * each
            rank += full * each
    return np.array(sorted(moves), np.int64).reshape(-1, 6), bins


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``part`` and ``rank`` number the pieces of one length within a task."""

    def run(batches_):
        from spidex.llm.tokens import batches, encoder

        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches_:
            ids_of, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts):
                flat, bounds = enc.encode(texts[a:b])
                out = [[] for _ in range(7 + with_ids)]
                for k in range(b - a):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    first = (n - 1) % capacity + 1
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        one = ids[start : first if piece == 0 else start + capacity]
                        row = (ids_of[a + k].as_py(), piece, start, len(one), zlib.crc32(one.tobytes()), part, seen[len(one)])
                        seen[len(one)] += 1
                        for c, v in zip(out, row + ((one.astype(np.int32),) if with_ids else ())):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=list(names[: len(out)]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document."""
    spark = docs.sparkSession
    pieces = cut(tokenised(docs, tokenizer, end_id, capacity, with_ids))
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = cut(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    moves, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(moves)

    def place(batches_):
        m = shared.value
        key = m[:, 0] * (1 << 46) + m[:, 1]
        for batch in batches_:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            at = m[np.searchsorted(key, length * (1 << 46) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            out |= {"sequence_id": pa.array(at[:, 4] + nth // at[:, 3]), "offset": pa.array(at[:, 5] + nth % at[:, 3] * length)}
            yield pa.RecordBatch.from_pydict(out)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    placed = pieces.join(base.select("length", "part", "base"), ["length", "part"]).select(*names, (F.col("base") + F.col("rank")).alias("nth"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return placed.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pack(..., with_ids=True): the ids of each sequence, at most its capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
