"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Document evidence: which hashed words and shape levels a text has, weighed by the log-odds between rejected and good
labelled rows (quality 0 or toxic 1 against the rest), from a sample of at most ``sample_rows`` labelled rows. Only odds of
``least_odds`` or more, beyond ``least_z`` standard errors, of words that rejected rows have after ``least_contexts`` or more different
words (copies of one text have them after the same) are evidence, and a text's evidence is the sum of all of them. Common words
are none, for or against: one insult in a long text outweighs any number of them. Tables have ``BUCKETS`` entries whatever the corpus.

Sites: a host (column ``host``, here ``source``) and a path on it (``path``; ``documents`` has none, so ``lang`` stands for it) have
beta posteriors of being rejected, from the labels of all their documents by grouped aggregation. A path shrinks toward its host and
a host toward the global rate; how much is estimated from the spread between hosts and between paths by moments, so sparse sites have
the prior of what is above them. The path's posterior is the prior of its documents, to which the evidence is added.

Defined results: a null text is an empty one; a null host or path is a site of its own; a document without labelled
neighbours has the global prior; without labels nothing is rejected; rows with one doc_id share a label, the worst; rows with a null
doc_id have none; a probability of exactly ``reject_at`` is kept; of labelled rows beyond the sample those with the smallest hashes of
doc_id are taken; a text of any length is read whole, some dozens of bytes for each of its bytes; an empty table gives an
empty result; ``classify`` keeps no other column than doc_id, ``kept_documents`` keeps all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spidex.llm.common import cut, free_names, mix, prefix_hash, repeated, span_hash, text_or_empty, word_spans

BUCKETS, SHAPES, LEVELS = 1 << 18, 7, 16
ENTRIES = BUCKETS + SHAPES * LEVELS
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(text: bytes, contexts: bool = False):
    """Distinct entries: hashed runs of letters in lower case, and the level of each shape.

    With contexts also a set of 64 bits for each entry: the hashed words before it; all bits for shapes.
    """
    data = np.frombuffer(text, np.uint8)
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    hashes = span_hash(prefix_hash(_LOWER[data]), edge[0::2], edge[1::2])
    words, of = np.unique((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_inverse=True)
    start, end = word_spans(data)
    n, letters = max(1, len(start)), max(1, int(letter.sum()))
    upper = int(((data >= 65) & (data <= 90)).sum())
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    distinct = len(np.unique(span_hash(prefix_hash(data), start, end)))
    shape = [upper / letters * 15, symbols / n * 8, (1 - distinct / n) * 15, repeated(text) / n * 15, text.count(b"|") / n * 8, text.count(b"!") / n * 8, np.log2(n)]
    levels = np.clip(np.array(shape), 0, LEVELS - 1).astype(np.int64)
    entries = np.concatenate([words, BUCKETS + np.arange(SHAPES) * LEVELS + levels])
    if not contexts:
        return entries
    before = np.full(len(entries), ~np.uint64(0))
    before[: len(words)] = 0
    np.bitwise_or.at(before, of, np.uint64(1) << (mix(np.append(np.uint64(0), hashes[:-1])[: len(hashes)]) & np.uint64(63)))
    return entries, before


def _judged(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of each labelled document."""
    bad = F.coalesce((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), F.col("toxic") == 1)
    return labels.select(F.col("doc_id").cast("long"), bad.cast("int").alias("bad")).filter("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))


def word_odds(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000, least_z: float = 2.5, least_odds: float = 3.0, least_contexts: int = 6) -> np.ndarray:
    """The log-odds of each entry, 0 where they may be chance."""
    sample = _judged(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # as many rows as ``sample_rows`` at most
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "bad")

    def run(batches_):
        seen, n, near = np.zeros((2, ENTRIES), np.int64), np.zeros(2, np.int64), np.zeros(ENTRIES, np.uint64)
        for batch in batches_:
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries, before = features(text.encode(), contexts=True)
                seen[bad, entries] += 1
                if bad:
                    near[entries] |= before
                n[bad] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)) for x, y in ((some, -1), (seen[0, some], n[0]), (seen[1, some], n[1]), (near[some].view(np.int64), 0))], names=["entry", "good", "bad", "near"])

    sums = rows.mapInArrow(run, "entry long, good long, bad long, near long").groupBy("entry").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bit_or("near").alias("near")).toArrow()  # ENTRIES + 1 rows at most
    seen, near = np.zeros((2, ENTRIES + 1)), np.zeros(ENTRIES + 1, np.uint64)
    near[sums["entry"].to_numpy()] = sums["near"].to_numpy().view(np.uint64)
    seen[0, sums["entry"].to_numpy()], seen[1, sums["entry"].to_numpy()] = sums["good"].to_numpy(), sums["bad"].to_numpy()
    (good, bad), (n_good, n_bad) = seen[:, :-1], seen[:, -1]
    if not n_good or not n_bad:
        return np.zeros(ENTRIES)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return np.where((z >= least_z) & (odds >= least_odds) & (np.bitwise_count(near[:-1]) >= least_contexts), np.minimum(odds, 8.0), 0.0)


def evidence(docs: DataFrame, odds: np.ndarray, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, source, lang, evidence) of every document; source is its host, lang its path."""
    shared = docs.sparkSession.sparkContext.broadcast(odds.astype(np.float32))

    def run(batches_):
        table = shared.value
        for batch in batches_:
            found = [float(table[features(t.as_py().encode())].sum(dtype=np.float64)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.float64())], names=["doc_id", "source", "lang", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("source"), F.col(path).cast("string").alias("lang"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, source string, lang string, evidence double")


def _strength(groups: DataFrame, above: str) -> float:
    """Pseudo-count of the beta prior of groups (n, bad) whose mean is column ``above``: by moments of what they show beyond binomial chance."""
    p, m = F.col("bad") / F.col("n"), F.col(above)
    rows = groups.filter("n > 1").agg(F.sum(F.pow(p - m, F.lit(2)) * F.col("n")), F.sum(m * (1 - m)), F.sum("n"), F.count(F.lit(1))).first()
    if not rows[3]:
        return 100.0
    spread, chance, n, k = (float(x) for x in rows)
    between = max(0.0, spread - chance) / n  # variance of the groups' true rates
    mean = chance / k
    return min(1e6, max(1.0, mean / between - 1)) if between > 0 and mean > 0 else 1e6


def site_priors(sites: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(source, lang, prior) of each path with labels, and the global rate. ``sites`` is (doc_id, source, lang)."""
    paths = cut(sites.join(_judged(labels), "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")))
    n, bad = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    rate = (bad + 0.5) / (n + 1) if n else 0.0
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("rate", F.lit(rate))
    k = _strength(hosts, "rate")
    hosts = hosts.select(F.col("source").alias("host"), ((F.col("bad") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    nested = paths.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    k = _strength(nested, "host_rate")
    return nested.select(F.col("source").alias("s"), F.col("lang").alias("l"), ((F.col("bad") + k * F.col("host_rate")) / (F.col("n") + k)).alias("prior")), rate


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000, reject_at: float = 0.9, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, p_bad, kept) of every document."""
    scored = cut(evidence(docs, word_odds(docs, labels, sample_rows), host, path))
    priors, rate = site_priors(scored.select("doc_id", "source", "lang"), labels)
    if not rate:
        return scored.select("doc_id", F.lit(0.0).alias("p_bad"), F.lit(True).alias("kept"))
    joined = scored.join(priors, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")), "left")
    prior = F.coalesce("prior", F.lit(rate))
    logit = F.log(prior / (1 - prior)) + F.col("evidence")
    return joined.select("doc_id", (1 / (1 + F.exp(-logit))).alias("p_bad")).withColumn("kept", F.col("p_bad") <= reject_at)


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept; rows with a null doc_id stay."""
    (rejected,) = free_names(docs, "rejected")
    gone = classify(docs, labels, **how).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(rejected)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(rejected), "left_anti")
