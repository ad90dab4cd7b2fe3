"""Token ids in files: fixed-width bit packing with block offsets.

An id takes ``bits`` = the minimum bits of the vocabulary. A data set is a Parquet table with one row for each
block; a block holds whole documents (about ``block_ids`` ids; a longer document is a block of its own), in
ascending order of doc_id over shards and blocks:

    shard int, block int      place of the block; shards are ranges of doc_id in order
    doc_ids array<long>       its documents
    starts array<long>        ids of the shard before each document
    counts array<long>        ids of each document
    n_ids long, bits int      ids in the block and the width of each
    payload binary            id k in bits [k * bits, (k + 1) * bits), the highest bit first, zero-filled to a byte

so that any id or document is read by one seek and unpacked with numpy. Rows carry no state of other rows: readers prune
by shard, block or n_ids and never touch payloads they don't need.

Defined results: null and empty texts have the end id alone; null doc_ids come first; equal doc_ids stay
separate documents; an empty table gives an empty data set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.llm.common import shuffle_partitions, text_or_empty

SCHEMA = "shard int, block int, doc_ids array<long>, starts array<long>, counts array<long>, n_ids long, bits int, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "starts", "counts")), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary())])


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack_bits(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """ids [first, first + count) without reading what is before them."""
    if bits == 16:
        return np.frombuffer(data, ">u2", count, 2 * first).astype(np.uint32)
    a, b = first * bits, (first + count) * bits
    flat = np.unpackbits(np.frombuffer(data, np.uint8)[a // 8 : (b + 7) // 8])[a % 8 : a % 8 + count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 16) -> None:
    def run(batches_):
        from spidex.llm.tokens import batches, encoder

        enc, shard, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        bits = max(1, (max(enc.vocabulary - 1, end_id)).bit_length())
        held: list = []  # (doc_id, ids)

        def flush():
            nonlocal block, before, held
            counts = [len(i) for _, i in held]
            starts = (before + np.cumsum([0, *counts[:-1]])).tolist()
            ids = np.concatenate([i for _, i in held])
            row = [[shard], [block], [[d for d, _ in held]], [starts], [counts], [len(ids)], [bits], [pack_bits(ids, bits)]]
            block, before, held = block + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ARROW.types)], schema=_ARROW)

        size = 0
        for batch in batches_:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                flat, bounds = enc.encode(texts[a:b])
                for k in range(b - a):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    if held and size + len(ids) > block_ids:
                        yield flush()
                        size = 0
                    held.append((doc_ids[a + k], ids))
                    size += len(ids)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before each; one row a shard, so one small window."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def decoded(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone."""

    def run(batches_):
        for batch in batches_:
            for r in batch.to_pylist():
                ids = unpack_bits(r["payload"], r["bits"], 0, r["n_ids"]).astype("<u4")
                base, out = (r["starts"] or [0])[0], [[] for _ in range(5 + with_ids)]
                for d, s, n in zip(r["doc_ids"], r["starts"], r["counts"]):
                    one = ids[s - base : s - base + n]
                    for c, v in zip(out, (d, r["shard"], s, n, zlib.crc32(one.tobytes()), one.astype(np.int32))):
                        c.append(v)
                names = ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names[: len(out)])

    schema = "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = blocks.mapInArrow(run, schema)
    starts = F.broadcast(shard_starts(blocks))  # one row for each shard: as many as the writer had partitions
    return rows.join(starts, "shard").select("doc_id", (F.col("in_shard") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
