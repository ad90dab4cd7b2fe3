"""Incremental indexing: each micro-batch of pages becomes one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from spidex.operators.index import build_segment
from spidex.operators.segments import MERGE_AT, SegmentStore, latest


def unseen_stream(urls: DataFrame, column: str = "url") -> DataFrame:
    """Each URL once over the life of the stream. The state never expires, so it grows with the URLs."""
    return urls.dropDuplicates([column])


def index_stream(pages: DataFrame, store: SegmentStore, first_segment: int | None = None, order: str | None = None, merge_at: int | None = MERGE_AT, name: str | None = None) -> DataStreamWriter:
    """A writer of ``pages`` (doc_id, title, text[, order]) into ``store``.

    A batch takes the store's next id, ``first_segment`` at least, and is written once however often it is replayed: the store notes the last batch of
    each stream under ``name``, by default the query's id, which its checkpoint keeps. Segments are merged once there are ``merge_at`` (None: never).
    Within a batch the latest copy of a document wins where ``order`` is given, else any one.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        stream = name or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if stream is None:
            raise ValueError("the stream has no id: give it a name")
        one = latest(batch, ["doc_id"], order) if order else batch.dropDuplicates(["doc_id"])
        one = one.persist()  # read for postings and for lengths
        try:
            store.flush_batch(stream, batch_id, *build_segment(one), least_id=first_segment or 1)
        finally:
            one.unpersist()
        if merge_at is not None:
            store.maybe_merge(merge_at)

    return pages.writeStream.foreachBatch(take)
