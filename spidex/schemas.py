"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _L, _I, _TS, _D = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.DoubleType()

PAGE_METADATA = _table(
    ("id", _S), ("url", _S), ("domain_id", _L), ("title", _S), ("text", _S), ("description", _S), ("canonical_url", _S),
    ("http_status", _I), ("language", _S), ("content_hash", _S), ("page_last_updated_at", _TS), ("index_status", _S), ("created_at", _TS), ("updated_at", _TS),
)
PENDING_CRAWL = _table(("id", _S), ("url", _S), ("domain_id", _L), ("retry_after", _TS), ("attempt_count", _I), ("last_error", _S), ("created_at", _TS), ("updated_at", _TS))
DOMAIN = _table(("id", _L), ("domain_name", _S), ("next_available_at", _TS), ("crawl_delay_ms", _I), ("max_pages", _I), ("pages_crawled", _I), ("created_at", _TS), ("updated_at", _TS))
PAGE_LINK = _table(("id", _L), ("source_page_id", _S), ("target_url", _S), ("target_page_id", _S), ("anchor_text", _S), ("discovered_at", _TS))
DOC_LOCATION = _table(("doc_id", _S), ("segment_id", _L))
PAGE_RANK = _table(("page_id", _S), ("score", _D))
SEEN_URLS = _table(("url", _S))
SEGMENTS_META = _table(("segment_id", _L), ("format_version", _I), ("doc_count", _L), ("title_total", _L), ("text_total", _L))
STREAM_BATCHES = _table(("stream", _S), ("batch_id", _L), ("segment_id", _L), ("done", T.BooleanType()))
ROBOTS_RULES = _table(("disallow", T.ArrayType(_S)), ("allow", T.ArrayType(_S)), ("crawl_delay_s", _I))
LINK = _table(("ord", _I), ("href", _S), ("anchor", _S))
PARSED_PAGE = _table(("title", _S), ("text", _S), ("description", _S), ("canonical_url", _S), ("language", _S), ("links", T.ArrayType(LINK)))


def postings(key: T.DataType = _S) -> T.StructType:
    return _table(("segment_id", _L), ("term", _S), ("doc_id", key), ("title_tf", _I), ("text_tf", _I), ("positions", T.ArrayType(_I)))


def doc_lengths(key: T.DataType = _S) -> T.StructType:
    return _table(("segment_id", _L), ("doc_id", key), ("title_len", _I), ("text_len", _I))
