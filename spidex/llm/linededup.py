"""Line dedup by winnowing over line hashes, with DataFrame operations alone.

A text is the sequence of its lines that hold a word. A run repeats if it has ``min_lines`` lines or more, or holds a line of
``long_words`` words or more, and occurs earlier, in order of (doc_id, place). Lines of later repeats are deleted.

1. Winnowing: the least line hash in each window of ``min_lines`` lines is a fingerprint, and so is each long line. Every run that
   can repeat holds one, at the same place in each of its copies. Fingerprints alone are shuffled and counted.
2. Positions are joined: each window with a fingerprint that occurs twice or more meets the first occurrence of its lines.
3. Extension both ways: windows at consecutive places whose first occurrences are at consecutive places of one document are one match, as
   long as it goes on to either side. A match is a run and the place that it repeats (:func:`repeated_runs`); its lines are deleted.

A line goes if any run over it occurs earlier, so the first occurrence of each window is all that is to be met. Groups are
counted with partial sums and joined back by hash, where hot lines split; no pairs are formed. Work is linear in the lines of a text,
however many it has; one text's lines are one array.

Defined results: lines without a word stay and don't part a run; null texts stay null; an empty text has no line; rows of one doc_id and
one text are one document, changed alike; null doc_ids come first; texts under one doc_id go by the hash of the text; an empty table
gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.llm.common import WORD, bound, cut, free_names, text_or_empty

HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, doc, lines): hash, place and whether it is long, of each line with a word."""
    split = F.split(text_or_empty(), "\n", -1)
    lines = F.filter(F.transform(split, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("at"), x.alias("line"))), lambda s: s["line"].rlike(HAS_WORD))
    slim = F.transform(lines, lambda s: F.struct(s["h"].alias("h"), s["at"].alias("at"), (F.regexp_count(s["line"], F.lit(WORD)) >= long_words).alias("long")))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("doc"), slim.alias("lines")).filter(F.size("lines") > 0).dropDuplicates(["doc_id", "doc"])


def _windows(min_lines: int) -> Column:
    """Of each window: its fingerprint's hash and place, the hash of its lines, where it starts among the lines, and its first and last place."""
    window = lambda i: F.slice("lines", i, min_lines)
    least = lambda a: F.array_min(F.transform(a, lambda s: F.struct(s["h"].alias("h"), s["at"].alias("at"))))
    starts = F.when(F.size("lines") >= min_lines, F.sequence(F.lit(1), F.size("lines") - (min_lines - 1))).otherwise(F.array().cast("array<int>"))
    unit = lambda w, i: F.struct(least(w).alias("print"), F.xxhash64(F.transform(w, lambda s: s["h"])).alias("unit"), i.alias("nth"), w[0]["at"].alias("first_at"), w[min_lines - 1]["at"].alias("last_at"))
    return F.transform(starts, lambda i: bound(window(i), lambda w: unit(w, i)))


def _longs() -> Column:
    """The same of each long line; the fingerprint is of its own kind."""
    line = lambda s, i: F.struct(F.struct(F.xxhash64(s["h"], F.lit(True)).alias("h"), s["at"].alias("at")).alias("print"), F.xxhash64(s["h"]).alias("unit"), (i + 1).alias("nth"), s["at"].alias("first_at"), s["at"].alias("last_at"))
    return F.filter(F.transform("lines", lambda s, i: F.when(s["long"], line(s, i))), lambda u: u.isNotNull())


def repeated_runs(docs: DataFrame, min_lines: int = 2, long_words: int = 20) -> DataFrame:
    """(doc_id, doc, first_at, last_at, source_id, source_doc, source_at): each later repeat, its first and last place, and what it repeats.

    ``doc`` is the hash of doc_id and text; ``source_at`` counts lines with a word, from 1.
    """
    lines = cut(_lines(docs, long_words))
    units = lines.select("doc_id", "doc", _windows(min_lines).alias("windows"), _longs().alias("longs"))
    # a fingerprint of neighbouring windows is one occurrence: places of window minima don't go back
    fresh = F.filter("windows", lambda u, i: (i == 0) | (F.get("windows", i - 1)["print"]["at"] != u["print"]["at"]))
    prints = units.select(F.explode(F.transform(F.concat(fresh, "longs"), lambda u: u["print"]["h"])).alias("h"))
    shared = cut(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    place = F.struct("doc_id", "doc", "nth")
    exploded = units.select("doc_id", "doc", F.size("windows").alias("k"), F.posexplode(F.concat("windows", "longs")).alias("i", "u"))
    keyed = exploded.select("doc_id", "doc", (F.col("i") >= F.col("k")).alias("alone"), F.col("u.print.h").alias("h"), "u.unit", "u.nth", "u.first_at", "u.last_at")
    candidates = cut(keyed.join(shared, "h", "left_semi").drop("h"))
    firsts = cut(candidates.groupBy("unit", "alone").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"))
    later = candidates.join(firsts, ["unit", "alone"]).filter(~place.eqNullSafe(F.col("first")))
    matched = later.select("doc_id", "doc", "nth", "first_at", "last_at", F.col("first.doc_id").alias("source_id"), F.col("first.doc").alias("source_doc"), F.col("first.nth").alias("source_at"))
    # a document's matches are as many as its lines
    side = W.partitionBy("doc_id", "doc", "source_id", "source_doc", F.col("nth") - F.col("source_at")).orderBy("nth")
    opens = F.coalesce(F.col("nth") > F.lag("nth").over(side) + 1, F.lit(True)).cast("int")
    grown = matched.repartition("doc_id", "doc").withColumn("opens", opens).withColumn("run", F.sum("opens").over(side))
    of = ["doc_id", "doc", "source_id", "source_doc", (F.col("nth") - F.col("source_at")).alias("shift"), "run"]
    return grown.groupBy(*of).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("source_at").alias("source_at")).select("doc_id", "doc", "first_at", "last_at", "source_id", "source_doc", "source_at")


def repeated_spans(docs: DataFrame, min_lines: int = 2, long_words: int = 20) -> DataFrame:
    """(doc_id, doc, spans): of each document with repeats the places that they cover, as (first, last), apart from each other and in order."""
    runs = repeated_runs(docs, min_lines, long_words)
    order = W.partitionBy("doc_id", "doc").orderBy("first_at", "last_at")
    reach = F.max("last_at").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = runs.withColumn("opens", F.coalesce(F.col("first_at") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "doc", "span").agg(F.min("first_at").alias("first"), F.max("last_at").alias("last"))
    return merged.groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _kept(parts: Column, spans: str) -> Column:
    """The lines of ``parts`` outside the spans, and those inside that hold no word; each line is looked at once."""
    end = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(spans, i - 1)["last"])
    between = lambda i: F.slice(parts, end(i) + 2, F.coalesce(F.get(spans, i)["first"], F.size(parts)) - end(i) - 1)
    inside = lambda i: F.slice(parts, F.get(spans, i)["first"] + 1, F.get(spans, i)["last"] - F.get(spans, i)["first"] + 1)
    blank = lambda i: F.coalesce(F.filter(inside(i), lambda x: ~x.rlike(HAS_WORD)), F.array().cast("array<string>"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.concat(between(i), blank(i))))


def marked(docs: DataFrame, min_lines: int = 2, long_words: int = 20) -> tuple[DataFrame, str]:
    """``docs`` with its text cut, and the name of a column that it got: how many lines went (null: none)."""
    key, doc, id_, spans, kept, gone = free_names(docs, "key", "doc", "id", "spans", "kept", "gone")
    found = cut(repeated_spans(docs, min_lines, long_words)).toDF(id_, doc, spans)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()))
    joined = keyed.join(found, (F.col(key) == F.col(doc)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    cut_ = bound(F.split("text", "\n", -1), lambda parts: bound(_kept(parts, spans), lambda left: F.struct(F.array_join(left, "\n").alias("text"), (F.size(parts) - F.size(left)).alias("gone"))))
    changed = joined.withColumn(kept, F.when(F.col(spans).isNotNull(), cut_)).withColumn("text", F.when(F.col(spans).isNotNull(), F.col(f"{kept}.text")).otherwise(F.col("text")))
    return changed.select(*docs.columns, F.col(f"{kept}.gone").alias(gone)), gone


def dedup_lines(docs: DataFrame, min_lines: int = 2, long_words: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, without the lines of later repeated runs, and with ``n_chars`` of what is left if there is such a column."""
    out, gone = marked(docs, min_lines, long_words)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def digests(docs: DataFrame, min_lines: int = 2, long_words: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    rows, gone = marked(docs.select("doc_id", "text", F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines")), min_lines, long_words)
    return rows.select(F.col("doc_id").cast("long"), "n_lines", F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


#: The same as digests() in DuckDB's SQL, by every run of two lines and every long line rather than by fingerprints.
ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split),
lines AS (
  SELECT doc_id, line, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
pairs AS (
  SELECT a.doc_id, a.line AS x, b.line AS y, a.place AS p, b.place AS q
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.nth = a.nth + 1
),
later AS (
  SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, p) AS seen FROM pairs) WHERE seen > 1
),
gone AS (
  SELECT doc_id, p AS place FROM later UNION SELECT doc_id, q FROM later
  UNION SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS seen FROM lines WHERE words >= 20) WHERE seen > 1
),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.place) AS text
  FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.place = g.place GROUP BY r.doc_id
)
SELECT s.doc_id, CAST(len(s.parts) AS BIGINT) AS n_lines,
  CAST((SELECT count(*) FROM gone g WHERE g.doc_id = s.doc_id) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
