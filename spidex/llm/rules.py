"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed byte n-grams: of trusted texts (every one that is labelled good and not
toxic) and of the raw corpus (every text), all whole. A text's score is the mean over its n-grams of
log p_trusted / p_raw, so length doesn't matter; it is kept at ``threshold`` or above. Both tables have a fixed size
whatever the corpus, so they are summed on the driver and broadcast.

Defined results: a null or empty text has all counts zero and fails the base rules; without trusted labels every score is 0 and
the method keeps; equal rows get equal rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spidex.llm.common import mix, repeated_words, text_or_empty

BUCKETS, ORDER, SYMBOLS = 1 << 16, 3, b"#*$%&|<>"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def grams(data: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each byte n-gram."""
    n = len(data) - order + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h = h * np.uint64(257) + data[k : k + n] + np.uint64(1)
    return (mix(h) & np.uint64(buckets - 1)).astype(np.int64)


def base_counts(texts: list[bytes]) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each."""
    words, repeated = repeated_words(texts)
    out = []
    for t, n, r in zip(texts, words.tolist(), repeated.tolist()):
        chars = len(t.translate(None, b" \t\n\r\x0b\x0c").decode("utf-8", "surrogatepass"))
        lines = [x for x in t.split(b"\n") if x.split(None, 1)]
        out.append((n, chars, len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), r))
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket comes in all texts."""

    def run(batches_):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches_:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(grams(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for b, n in docs.select(text_or_empty().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[b] = n
    return out


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_trusted / p_raw of each bucket."""
    raw = gram_counts(docs)
    # the ids grow with the labels, so they are dealt with the texts at every size and never broadcast
    trusted = gram_counts(docs.select(F.col("doc_id").cast("long"), "text").join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi"))
    if not trusted.sum():
        return np.zeros(BUCKETS)
    back = (raw + 0.5) / (raw + 0.5).sum()
    # the trusted side falls back on the raw one, in proportion to how little it has seen
    return np.log((trusted + BUCKETS * back) / (trusted.sum() + BUCKETS)) - np.log(back)


def judge(docs: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """The base counts, base_failed, score and kept of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches_):
        ratio = shared.value
        for batch in batches_:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                base = base_counts(texts)
                scores = [float(ratio[g].mean(dtype=np.float64)) if len(g := grams(np.frombuffer(t, np.uint8))) else 0.0 for t in texts]
                failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
                kept = [not f and s >= threshold for f, s in zip(failed, scores)]
                columns = [part.column(0), *(pa.array([b[k] for b in base], pa.int64()) for k in range(5)), pa.array(failed), pa.array(scores), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BASE.split(", ")] + ["score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, BASE + ", score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.05) -> DataFrame:
    return judge(docs, log_ratio(docs, labels), threshold)
