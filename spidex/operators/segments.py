"""Immutable segments under a manifest: flush, live copies, merge, reset, recovery.

root/postings/segment_id=N and root/doc_lengths/segment_id=N hold a segment. Postings are dealt by document to files of about ``PART_TOKENS``
tokens, each sorted by term so that its pages and row groups prune: no term is a single task's, and nothing is sorted that memory doesn't hold. root/tables/NAME/vK holds version K of a small table (segments_meta, doc_location, ...). A change writes the next version beside the old one and is there
once its marker of success is; readers take the newest that has one, so nothing half-written is ever read. A store has one writer
at a time; the last ``KEPT`` versions stay for readers.

One counter gives all ids, of flushes, merges and micro-batches: one more than any that the manifest or a batch in progress has. A
micro-batch notes its id before it writes, so a replay writes the same segment again, or nothing if it was done.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spidex import schemas

FORMAT_VERSION, MERGE_AT, KEPT = 1, 10, 3
PART_TOKENS = 1 << 22
#: How postings are dealt while a segment is written: by document to as many parts as are asked for, and joined with live copies without another sort.
_DEALT = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


@contextlib.contextmanager
def dealt(spark: SparkSession, parts: int):
    """Within the block what shuffles goes to ``parts`` parts."""
    wanted = {**_DEALT, "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Files:
    """The store's own file system, through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` for each key."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def delete_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on), on, "left_anti")


class TableStore:
    """Versioned small tables; ``write`` of what was read from the same table is safe."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, T.StructType]):
        self.spark, self.root, self.tables, self.files = spark, root.rstrip("/"), tables, Files(spark, root)
        self.files.make(self.root)

    def _versions(self, name: str) -> list[int]:
        folder = f"{self.root}/tables/{name}"
        return sorted(int(v[1:]) for v in self.files.names(folder) if v[1:].isdigit() and self.files.exists(f"{folder}/{v}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(f"{self.root}/tables/{name}/v{found[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        found = self._versions(name)
        schema = self.tables[name]
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("overwrite").parquet(f"{self.root}/tables/{name}/v{(found or [0])[-1] + 1}")
        for old in found[: 1 - KEPT]:  # the last ones may still be read
            self.files.delete(f"{self.root}/tables/{name}/v{old}")


class SegmentStore:
    def __init__(self, spark: SparkSession, root: str, key: T.DataType = T.StringType()):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        location = T.StructType([T.StructField("doc_id", key), T.StructField("segment_id", T.LongType())])
        self.tables = TableStore(spark, root, {"segments_meta": schemas.SEGMENTS_META, "doc_location": location, "stream_batches": schemas.STREAM_BATCHES})
        self.files = self.tables.files
        self.recover()

    def recover(self) -> None:
        """Folders that no manifest names, of writes that didn't end, go; other names are not ours."""
        known = set(self.ids())
        for kind in ("postings", "doc_lengths"):
            for name in self.files.names(f"{self.root}/{kind}"):
                number = name.removeprefix("segment_id=")
                if name.startswith("segment_id=") and number.isdigit() and int(number) not in known or name.endswith(".tmp"):
                    self.files.delete(f"{self.root}/{kind}/{name}")

    def meta(self) -> DataFrame:
        return self.tables.read("segments_meta")

    def ids(self) -> list[int]:
        return sorted(r[0] for r in self.meta().select("segment_id").collect())  # one row a segment

    def next_id(self) -> int:
        begun = self.tables.read("stream_batches").filter("not done").agg(F.max("segment_id")).first()[0] or 0
        return max(begun, *self.ids(), 0) + 1

    def location(self) -> DataFrame:
        return self.tables.read("doc_location")

    def _load(self, kind: str, schema: T.StructType, ids: list[int]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{kind}/segment_id={i}" for i in ids]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths)
        return rows.select(*schema.names)

    def active(self, ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, doc_lengths) of a fixed list of segments: a later change doesn't alter what these read."""
        ids = self.ids() if ids is None else ids
        return self._load("postings", schemas.postings(self.key), ids), self._load("doc_lengths", schemas.doc_lengths(self.key), ids)

    def validate(self) -> None:
        """Raises ValueError on an unknown format, a segment whose documents aren't as many as its manifest says, or postings that don't add up to their documents' lengths."""
        bad = self.meta().filter(F.coalesce(F.col("format_version"), F.lit(-1)) != FORMAT_VERSION).select("segment_id").first()
        if bad:
            raise ValueError(f"segment {bad[0]} has another format")
        postings, lengths = self.active()
        counts = lengths.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
        wrong = self.meta().join(counts, "segment_id", "left").filter(F.coalesce("n", F.lit(0)) != F.coalesce("doc_count", F.lit(-1))).first()
        if wrong:
            raise ValueError(f"segment {wrong['segment_id']} has {wrong['n']} documents, not {wrong['doc_count']}")
        sums = postings.groupBy("segment_id", "doc_id").agg(F.sum("title_tf").alias("t"), F.sum("text_tf").alias("x"), F.bool_and(F.size("positions") == F.col("text_tf")).alias("whole"))
        fits = F.col("whole") & (F.col("t") == F.col("title_len")) & (F.col("x") == F.col("text_len"))
        empty = F.col("t").isNull() & (F.col("title_len") == 0) & (F.col("text_len") == 0)
        odd = sums.join(lengths, ["segment_id", "doc_id"], "full_outer").filter(~F.coalesce(fits, empty, F.lit(False))).first()
        if odd:
            raise ValueError(f"segment {odd['segment_id']} has postings that don't fit document {odd['doc_id']}")

    def _write(self, segment_id: int, postings: DataFrame, lengths: DataFrame) -> tuple[int, int, int, int]:
        """Writes a segment's files; its row of the manifest."""
        p, d = f"{self.root}/postings/segment_id={segment_id}", f"{self.root}/doc_lengths/segment_id={segment_id}"
        lengths.select("doc_id", "title_len", "text_len").write.mode("overwrite").parquet(d)
        sums = self.spark.read.parquet(d).agg(F.count(F.lit(1)), F.coalesce(F.sum("title_len"), F.lit(0)), F.coalesce(F.sum("text_len"), F.lit(0))).first()
        with dealt(self.spark, -(-(sums[1] + sums[2]) // PART_TOKENS) or 1):
            ordered = postings.select("term", "doc_id", "title_tf", "text_tf", "positions").sortWithinPartitions("term", "doc_id")
            ordered.write.mode("overwrite").parquet(p)
        return (segment_id, *sums)

    def _publish(self, keep: list[int], new: list[tuple]) -> None:
        """The manifest: rows of ``keep``, and of new segments (id, documents[, title tokens, text tokens])."""
        rows = [(i, FORMAT_VERSION, n, *(sums or (None, None))) for i, n, *sums in new]
        self.tables.write("segments_meta", self.meta().filter(F.col("segment_id").isin(keep)).unionByName(self.spark.createDataFrame(rows, schemas.SEGMENTS_META)))

    def corpus(self) -> DataFrame:
        """corpus_stats() of all segments from the manifest alone."""
        n = F.sum("doc_count")
        average = lambda c: F.coalesce(F.sum(c) / F.nullif(n, F.lit(0)), F.lit(0.0))
        return self.meta().agg(F.coalesce(n, F.lit(0)).alias("total_docs"), average("title_total").alias("avg_title_len"), average("text_total").alias("avg_text_len"))

    def flush(self, postings: DataFrame, lengths: DataFrame, segment_id: int | None = None, again: bool = False) -> int | None:
        """The id of the new segment, which then holds the live copies of its documents; None, and nothing written, without documents.

        A given id that the manifest has is an error, or with ``again`` written anew.
        """
        if lengths.isEmpty():
            return None
        ids = self.ids()
        segment_id = self.next_id() if segment_id is None else segment_id
        if segment_id in ids and not again:
            raise FileExistsError(f"segment {segment_id} exists")
        made = self._write(segment_id, postings, lengths)
        self._publish([i for i in ids if i != segment_id], [made])
        written = self._load("doc_lengths", schemas.doc_lengths(self.key), [segment_id])
        self.tables.write("doc_location", upsert(self.location(), written.select("doc_id", "segment_id"), ["doc_id"]))
        return segment_id

    def flush_batch(self, stream: str, batch_id: int, postings: DataFrame, lengths: DataFrame, least_id: int = 1) -> int | None:
        """flush() once for each batch of a stream, however often it is called; None where the batch is empty or was done."""
        last = self.tables.read("stream_batches").filter(F.col("stream") == stream).first()  # one row a stream
        if last and (last["batch_id"] > batch_id or last["batch_id"] == batch_id and last["done"]):
            return None
        replay = last is not None and last["batch_id"] == batch_id
        segment_id = last["segment_id"] if replay else max(self.next_id(), least_id)
        self._note(stream, batch_id, segment_id, False)
        made = self.flush(postings, lengths, segment_id, again=replay)
        self._note(stream, batch_id, segment_id, True)
        return made

    def _note(self, stream: str, batch_id: int, segment_id: int, done: bool) -> None:
        row = self.spark.createDataFrame([(stream, batch_id, segment_id, done)], schemas.STREAM_BATCHES)
        self.tables.write("stream_batches", upsert(self.tables.read("stream_batches"), row, ["stream"]))

    def merged(self, ids: list[int], segment_id: int) -> tuple[DataFrame, DataFrame]:
        """Live rows of some segments under a new id."""
        postings, lengths = self.active(ids)
        live = self.location()
        keep = lambda rows: rows.join(live, ["doc_id", "segment_id"], "left_semi").withColumn("segment_id", F.lit(segment_id).cast("long")).select(*rows.columns)
        return keep(postings), keep(lengths)

    def replace(self, ids: list[int], segment_id: int) -> dict:
        """Merge segments: written first, then named by the manifest, live copies repointed, inputs deleted last."""
        before = self.active(ids)[1].count()
        if segment_id in self.ids():
            raise FileExistsError(f"segment {segment_id} exists")
        made = self._write(segment_id, *self.merged(ids, segment_id))
        self._publish([i for i in self.ids() if i not in ids], [made])
        moved = F.when(F.col("segment_id").isin(ids), F.lit(segment_id).cast("long")).otherwise(F.col("segment_id"))
        self.tables.write("doc_location", self.location().withColumn("segment_id", moved))
        for i in ids:
            for kind in ("postings", "doc_lengths"):
                self.files.delete(f"{self.root}/{kind}/segment_id={i}")
        return {"segment_id": segment_id, "documents": made[1], "stale_copies": before - made[1]}

    def maybe_merge(self, trigger: int = MERGE_AT) -> dict | None:
        """Merge all segments once there are ``trigger``; what came of it."""
        ids = self.ids()
        return self.replace(ids, self.next_id()) if len(ids) >= trigger else None

    def forget(self, doc_ids: DataFrame) -> None:
        """Documents (doc_id) without a live copy from now on."""
        self.tables.write("doc_location", delete_keys(self.location(), doc_ids, "doc_id"))

    def reset(self) -> None:
        self.tables.write("segments_meta", self.spark.createDataFrame([], schemas.SEGMENTS_META))
        self.tables.write("doc_location", self.location().limit(0))
        for kind in ("postings", "doc_lengths"):
            self.files.delete(f"{self.root}/{kind}")
