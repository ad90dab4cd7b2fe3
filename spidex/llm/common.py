"""Shared pieces: inputs, cut lineage, temporary tables, word arithmetic, connected components."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spidex.operators.lineage import cut, scratch, shared_dir  # noqa: F401 (shared with the modules here)

#: What separates words: space and the ASCII control characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of our own that ``df`` doesn't have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda, Spark computes an expression again for each element."""
    return F.transform(F.array(value), body)[0]


@contextlib.contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Within the block each query removes its shuffle files when it ends, so steps do not add up on disk."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long): label is the smallest node reachable.

    Alternates large-star and small-star steps; each is one grouped aggregation, a component of any shape ends
    after O(log n) rounds, and no group's rows are collected: both steps need only the minimum of a
    node's neighbours, joined back to its edges, where Spark splits the edges of a hub at run time (AQE).
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        """pairs (u, v), both ways for the large star; links each v on the star's side to the least neighbour."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = pairs.join(least, "u")
        if small:
            out = joined.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        else:
            out = joined.filter("v > u").select("v", "m")
        return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    state = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, small=False)
        e = cut(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == state or now[0] == now[2] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any span of ``units``."""
    up, _ = powers(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(mix(units.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(units)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the units [start, end) of each span; equal spans, equal hashes, wherever they are."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those in windows of three words that the text has twice or more."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = word_spans(data)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    words = np.bincount(of, minlength=len(texts))
    if len(start) < 3:
        return words, np.zeros(len(texts), np.int64)
    h = span_hash(prefix_hash(data), start, end)
    window = mix(h[:-2]) * np.uint64(3) + mix(h[1:-1] + np.uint64(1)) * np.uint64(5) + mix(h[2:] + np.uint64(2)) + mix(of[:-2].astype(np.uint64))
    within = np.flatnonzero(of[:-2] == of[2:])
    order = within[np.argsort(window[within], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(len(start), bool)
    for k in range(3):
        again[order[1:][same] + k] = again[order[:-1][same] + k] = True
    return words, np.bincount(of[again], minlength=len(texts))


def repeated(text: bytes) -> int:
    return int(repeated_words([text])[1][0])
