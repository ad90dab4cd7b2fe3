"""The inverted index of a batch of pages, and the statistics that scoring needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spidex import schemas
from spidex.functions.text import tokens

AT_ONCE = 256  # documents whose terms are grouped at a time


def analysed(pages: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(doc_id, title_tokens, text_tokens): both fields tokenised once."""
    return pages.select(F.col(key).alias("doc_id"), tokens(title).alias("title_tokens"), tokens(text).alias("text_tokens"))


def _segment(segment_id: int | Column) -> Column:
    return (segment_id if isinstance(segment_id, Column) else F.lit(segment_id)).cast("long").alias("segment_id")


def _entries(texts: pa.Array, titles: pa.Array) -> pa.Array:
    """Of documents, whose fields are lists of token lists: list<struct<term, title_tf, text_tf, positions>> of each."""

    def flat(field: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Tokens, and for each its document and its place in its list."""
        lists = field.flatten()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(field)), field.value_lengths().to_numpy(zero_copy_only=False))
        return lists.flatten(), np.repeat(of, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    (text, of_text, place), (title, of_title, _) = flat(texts), flat(titles)
    coded = pa.concat_arrays([text, title]).dictionary_encode()
    terms, n_terms = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    keys = np.concatenate([of_text, of_title]) * n_terms + terms
    places = np.concatenate([place, np.full(len(title), -1)]).astype(np.int32)
    # places rise within a text; rows of one document are merged
    merged = len(texts) < max(len(texts.flatten()), len(titles.flatten()))
    order = np.lexsort((places, keys)) if merged else np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    in_text = places >= 0
    n, text_tf = np.diff(first, append=len(keys)), np.add.reduceat(in_text, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    ends = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    columns = {
        "term": coded.dictionary.take(pa.array(keys[first] % n_terms)),
        "title_tf": pa.array((n - text_tf).astype(np.int32)),
        "text_tf": pa.array(text_tf.astype(np.int32)),
        "positions": pa.ListArray.from_arrays(ends(text_tf), pa.array(places[in_text])),
    }
    return pa.ListArray.from_arrays(ends(np.bincount(keys[first] // n_terms, minlength=len(texts))), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


@F.arrow_udf(T.ArrayType(T.StructType([f for f in schemas.postings() if f.name not in ("segment_id", "doc_id")])))
def _grouped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, titles in batches:
        for at in range(0, len(texts), AT_ONCE):
            yield _entries(texts.slice(at, AT_ONCE), titles.slice(at, AT_ONCE))


def _postings(documents: DataFrame, segment_id: int | Column) -> DataFrame:
    """Of rows (doc_id, texts, titles), one of each document, whose fields are lists of token lists."""
    rows = documents.select("doc_id", F.explode(_grouped("texts", "titles")).alias("p"))
    return rows.select(_segment(segment_id), "p.term", "doc_id", "p.title_tf", "p.text_tf", "p.positions")


def postings(analysed_pages: DataFrame, segment_id: int | Column = 0) -> DataFrame:
    """One row for each (term, doc): tf of each field, and positions in the text, from 0."""
    return _postings(analysed_pages.groupBy("doc_id").agg(F.collect_list("text_tokens").alias("texts"), F.collect_list("title_tokens").alias("titles")), segment_id)


def doc_lengths(analysed_pages: DataFrame, segment_id: int | Column = 0) -> DataFrame:
    """Tokens of each field; a document without any has its row."""
    return analysed_pages.select(_segment(segment_id), "doc_id", F.size("title_tokens").alias("title_len"), F.size("text_tokens").alias("text_len"))


def build_segment(pages: DataFrame, segment_id: int = 0, key: str = "doc_id", title: str = "title", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, doc_lengths) of a batch.

    Rows are brought together by document before they are tokenised, and terms are grouped within a document: one copy of the text moves
    rather than a row for each token, and a task holds its texts, not a table of all its tokens.
    """
    raw = lambda c: F.collect_list(F.coalesce(F.col(c), F.lit("")))
    whole = pages.groupBy(F.col(key).alias("doc_id")).agg(raw(text).alias("texts"), raw(title).alias("titles"))
    return _postings(whole.select("doc_id", *(F.transform(c, tokens).alias(c) for c in ("texts", "titles"))), segment_id), doc_lengths(analysed(pages, key, title, text), segment_id)


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (total_docs, avg_title_len, avg_text_len) over all copies; averages are 0 without documents."""
    return lengths.agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.avg("title_len"), F.lit(0.0)).alias("avg_title_len"), F.coalesce(F.avg("text_len"), F.lit(0.0)).alias("avg_text_len"))


def segment_averages(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("segment_id").agg(F.count(F.lit(1)).alias("doc_count"), F.avg("title_len").alias("avg_title_len"), F.avg("text_len").alias("avg_text_len"))


def doc_freq(all_postings: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, df) over all copies; title-only postings count."""
    rows = all_postings if terms is None else all_postings.filter(F.col("term").isin(terms))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
