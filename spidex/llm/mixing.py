"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone.

Each source has a target in words. Among the rates 0..2 of its documents that meet it, those nearest to one copy each in
relative entropy are 2 / (1 + exp(-tilt * size / mean size)): exponentially tilted by size. The tilt of a source is the root of
its convex dual, found for all sources at once by Newton steps over the (source, size) histogram, each kept inside a
shrinking bracket. Rates become whole copies along a walk over the source's documents by size: copies are the
steps of the rounded running sum of rates, so what is taken follows what is wanted; at last a few documents a source,
those nearest in size to what is still missing or too much, take one copy more or less.

A source of any share of the rows is dealt over all tasks: the walk is sorted by range of (source, size, hash), summed
within each range, and continued over the ranges' sums.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source of size 0 has target
0; equal rows are documents of their own; an empty table gives an empty result; a tie in size falls by the hash of doc_id, then of
the text; a text of any length counts as its words; rows with a null doc_id take part; all columns are kept, whatever their names.

Reruns agree, however rows are dealt: rates are whole multiples of 2**-20, and what is summed over rows is whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.llm.common import WORD, cut, free_names, shuffle_partitions, text_or_empty

WEIGHTS = (5, 2, 1)
SCALE = 1 << 20  # of rates, as whole numbers


def source_key() -> Column:
    """Sorts as the code points of sources do, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))


def targets(sources: DataFrame, share: float, weights: tuple = WEIGHTS, most: float = 2.0) -> DataFrame:
    """sources (source_key, source_size) with ``target``: filled by weight up to ``most`` times the size, the excess reshared.

    The level to which all are filled is the first, by cap over weight, that its own cap doesn't stop. One row a source.
    """
    everywhere = W.partitionBy()
    nth = F.row_number().over(W.orderBy("source_key"))
    rows = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "source_key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(everywhere) - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(everywhere)["level"]
    return rows.select("source_key", F.col("source_size"), F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.lit(2.0) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / mean))))


def tilts(histogram: DataFrame, sources: DataFrame, rounds: int = 60, near: float = 1e-7) -> DataFrame:
    """(source_key, tilt) for sources whose target is inside (0, 2 * size); histogram is (source_key, size, n)."""
    # sums of decimals don't depend on their order
    exact = lambda x: F.sum((x * SCALE).cast("decimal(38,0)")).cast("double") / SCALE
    mean = histogram.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    inner = sources.filter("target > 0 and target < 2 * source_size * (1 - 1e-12)").join(mean, "source_key")
    start = F.log(F.col("target") / (2 * F.col("source_size") - F.col("target")))
    state = cut(inner.select("source_key", "target", "mean", start.alias("tilt"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done")))
    for _ in range(rounds):
        r = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size")
        sums = (
            histogram.join(state, "source_key")
            .groupBy("source_key")
            .agg(exact(words * r).alias("got"), exact(words * F.col("size") / F.col("mean") * r * (1 - r / 2)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap < 0, F.col("hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") - gap / F.nullif("slope", F.lit(0.0))
        inside = step.isNotNull() & (step > lo) & (step < hi)
        done = F.col("done") | (F.abs(gap) <= F.lit(near) * F.col("target"))
        state = cut(
            state.join(sums, "source_key").select(
                "source_key", "target", "mean", F.when(done, F.col("tilt")).when(inside, step).otherwise((lo + hi) / 2).alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("done")
            )
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("source_key", "tilt", "mean")


def _walk(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, source_key, size, tie, print, rate) in ranges of the walk's order, with ``copies``: steps of the rounded running sum."""
    within = W.partitionBy("range", "source_key").orderBy("size", "tie", "print", "row")
    sums = rows.groupBy("source_key", "range").agg(F.sum("rate").alias("sum"))
    base = sums.select("source_key", "range", F.coalesce(F.sum("sum").over(W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    to = F.col("base") + F.sum("rate").over(within.rowsBetween(W.unboundedPreceding, 0)) + SCALE // 2
    steps = F.expr(f"_to div {SCALE} - (_to - rate) div {SCALE}")
    return rows.join(cut(base), ["range", "source_key"]).withColumn("_to", to).withColumn("copies", steps).drop("_to")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, polish: int = 4) -> DataFrame:
    """(doc_id, source_key, size, print, source_size, target, copies) of every document; ``print`` is a hash of the text."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long"), source_key().alias("source_key"), size.alias("size"), F.xxhash64(text_or_empty()).alias("print")))
    histogram = cut(sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cut(targets(histogram.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights))
    rates = tilts(histogram, sources)
    about = cut(sources.join(rates, "source_key", "left"))
    # one row for each source: few, but not by proof, so Spark may only broadcast it below its own threshold
    rated = histogram.join(about, "source_key").select(
        "source_key",
        "size",
        "source_size",
        "target",
        F.round(SCALE * F.when(F.col("tilt").isNotNull(), _rate(F.col("tilt"), F.col("size"), F.col("mean"))).otherwise(F.when(F.col("target") > 0, 2.0).otherwise(0.0))).cast("long").alias("rate"),
    )
    tie = F.xxhash64("doc_id")
    ranged = cut(
        sized.withColumn("tie", tie)
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "source_key", "size", "tie", "print")
        .select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row"))
    )
    rows = cut(_walk(ranged.join(cut(rated), ["source_key", "size"])).select("row", "doc_id", "source_key", "size", "source_size", "target", "copies", "tie", "print"))
    changes, salts = None, shuffle_partitions(docs.sparkSession)
    for _ in range(polish):
        current = rows if changes is None else rows.join(changes.select("row", "change"), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        missing = current.groupBy("source_key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
        # a source may hold a third of all rows: its rows meet what it misses in ``salts`` parts
        missing = cut(missing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
        fits = F.when(F.col("missing") > 0, F.col("copies") < 2).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        off = F.abs(F.abs("missing") - F.col("size"))
        open_ = current if changes is None else current.join(changes.select("row"), "row", "left_anti")
        best = (
            open_.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
            .join(missing, ["source_key", "salt"])
            .filter(fits & (off < F.abs("missing")))
            .groupBy("source_key", "salt")
            .agg(F.min(F.struct(off.alias("off"), "tie", "print", "row", F.signum("missing").cast("long").alias("change"))).alias("best"))
            .groupBy("source_key")
            .agg(F.min("best").alias("best"))
            .select("best.row", "best.change")
        )
        changes = cut(best if changes is None else changes.unionByName(best))
    final = rows if changes is None else rows.join(changes, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return final.select("doc_id", "source_key", "size", "print", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; among rows of one doc_id, source and text any may be taken."""
    id_, source, size, tie, nth, copies, copy = free_names(docs, "id", "source", "size", "tie", "nth", "copies", "copy")
    keys = [id_, source, size, tie]
    # rows of one key are repeats of a document; a null doc_id is -1 here, apart by its text
    taken = mix(docs, **how).select(F.coalesce("doc_id", F.lit(-1)).alias(id_), F.col("source_key").alias(source), F.col("size").alias(size), F.col("print").alias(tie), F.col("copies").alias(copies))
    taken = taken.withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(copies))))
    numbered = docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(id_),
        source_key().alias(source),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias(size),
        F.xxhash64(text_or_empty()).alias(tie),
    ).withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(tie)))
    joined = numbered.join(cut(taken.filter(F.col(copies) > 0).select(*keys, nth, copies)), [*keys, nth])
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
