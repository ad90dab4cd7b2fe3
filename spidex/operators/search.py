"""BM25F relevance, exact phrases, the link boost, top-k and the whole search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spidex.functions.text import snippet, tokenize
from spidex.operators.index import corpus_stats, doc_freq

K1 = 1.5
TITLE_WEIGHT, TITLE_B, TEXT_WEIGHT, TEXT_B = 3.0, 0.3, 1.0, 0.75
LINK_WEIGHT = 0.5
LEAST_LIMIT, DEFAULT_LIMIT, MOST_LIMIT = 1, 10, 50


def distinct_terms(query: str) -> list[str]:
    return list(dict.fromkeys(tokenize(query)))


def is_phrase(query: str) -> bool:
    return len(query) > 2 and query[0] == query[-1] == '"'


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if limit is None else max(LEAST_LIMIT, min(MOST_LIMIT, limit))


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def _norm(length: str, average: str) -> Column:
    return F.when(F.col(average) == 0, F.lit(1.0)).otherwise(F.coalesce(F.col(length), F.lit(0)) / F.col(average))


def live_only(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of segments (segment_id, doc_id, ...) whose copy is the live one."""
    return rows.join(live.select("doc_id", "segment_id"), ["doc_id", "segment_id"], "left_semi")


def bm25f(postings: DataFrame, lengths: DataFrame, live: DataFrame, terms: list[str], candidates: DataFrame | None = None, stats: str = "code", corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of each live document with a term.

    corpus: corpus_stats() of all copies where they are known, as a store's manifest does; else lengths are read as a whole for them.
    stats: ``code`` counts stale copies in the number of documents, averages and frequencies, ``live`` doesn't. Only postings of
    the terms are read (the predicate reaches the scan, whose row groups are sorted by term).
    """
    terms = list(dict.fromkeys(terms))
    matching = postings.filter(F.col("term").isin(terms)).select("segment_id", "term", "doc_id", "title_tf", "text_tf")
    alive = live_only(matching, live)
    counted, measured = (alive, live_only(lengths, live)) if stats == "live" else (matching, lengths)
    # one row, and one row a query term
    known = corpus is not None and stats == "code"
    corpus, frequencies = F.broadcast(corpus if known else corpus_stats(measured)), F.broadcast(doc_freq(counted))
    rows = alive if candidates is None else alive.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(lengths.select("segment_id", "doc_id", "title_len", "text_len"), ["segment_id", "doc_id"], "left").join(frequencies, "term").crossJoin(corpus)
    pseudo = TITLE_WEIGHT * F.col("title_tf") / (1 - TITLE_B + TITLE_B * _norm("title_len", "avg_title_len")) + TEXT_WEIGHT * F.col("text_tf") / (1 - TEXT_B + TEXT_B * _norm("text_len", "avg_text_len"))
    score = idf(F.col("total_docs"), F.col("df")) * pseudo / (K1 + pseudo)
    return rows.filter(pseudo > 0).groupBy("doc_id").agg(F.sum(score).alias("score"))


def _hash_order(terms: list[str], n: int) -> list[str]:
    """The order in which a hash set of strings gives them back: by bucket of the spread string hash, then by insertion."""
    size = 16
    while size < max(n, 12) / 0.75:
        size *= 2

    def bucket(t: str) -> int:
        h = 0
        for c in t:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        return (h ^ (h >> 16)) & (size - 1)

    return sorted(terms, key=bucket)


def phrase_terms(phrase: str, compat: str = "default") -> list[str]:
    """The terms to find one after another: in query order with repeats, or (``code``) distinct and in hash order."""
    found = tokenize(phrase)
    return found if compat == "default" else _hash_order(list(dict.fromkeys(found)), len(found))


def phrase_matches(postings: DataFrame, terms: list[str], live: DataFrame | None = None) -> DataFrame:
    """(doc_id) whose text has the terms at consecutive positions within one segment; with ``live``, in its live copy.

    Each position votes for the start it would give the phrase; a start with the votes of all terms is a match. One shuffle,
    whatever the number of terms.
    """
    wanted = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(terms)))
    rows = postings.filter(F.col("term").isin(list(set(terms))) & (F.col("text_tf") > 0)).select("segment_id", "doc_id", "term", "positions")
    rows = rows if live is None else live_only(rows, live)
    places = F.transform(F.filter(wanted, lambda w: w["term"] == F.col("term")), lambda w: w["i"])
    votes = rows.select("segment_id", "doc_id", F.explode(places).alias("i"), "positions").select("segment_id", "doc_id", "i", F.explode("positions").alias("pos"))
    starts = votes.groupBy("segment_id", "doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return starts.filter(F.col("n") == len(terms)).select("doc_id").distinct()


def rank_bounds(ranks: DataFrame) -> DataFrame:
    """One row (lo, hi): the least and the largest score."""
    return ranks.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))


def link_boost(scores: DataFrame, ranks: DataFrame, boost: str = "code", weight: float = LINK_WEIGHT, key: str = "doc_id") -> DataFrame:
    """Scores times 1 + weight * x; x is the rank's place between the least and the largest on a log scale.

    ``code`` counts from the largest (x in -1..0), ``documented`` from the least (0..1). A document without a rank has the least;
    without ranks, or with equal ones, scores stay.
    """
    bounds = F.broadcast(rank_bounds(ranks).toDF("_min", "_max"))
    ranked = scores.join(ranks.select(F.col(ranks.columns[0]).alias(key), F.col("score").alias("_rank")), key, "left").crossJoin(bounds)
    origin = F.col("_max") if boost == "code" else F.col("_min")
    x = (F.log(F.coalesce("_rank", "_min")) - F.log(origin)) / (F.log("_max") - F.log("_min"))
    flat = F.col("_min").isNull() | (F.abs(F.col("_max") - F.col("_min")) < 1e-12)
    return ranked.withColumn("score", F.when(flat, F.col("score")).otherwise(F.col("score") * (1 + weight * x))).drop("_rank", "_min", "_max")


def top_k(scores: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def top_results(scores: DataFrame, pages: DataFrame, terms: list[str], limit: int = DEFAULT_LIMIT, key: str = "doc_id") -> DataFrame:
    """(url, title, snippet, score) of the best documents. Pages are joined after the limit, so only those texts are read; a page that is gone leaves its place empty."""
    best = F.broadcast(top_k(scores, clamp_limit(limit), key))  # MOST_LIMIT rows at most
    joined = pages.select(F.col(key).alias(key), "url", "title", "text").join(best, key)
    return joined.orderBy(F.desc("score"), F.asc(key)).select("url", "title", snippet("text", terms).alias("snippet"), "score")


def search(query: str, postings: DataFrame, lengths: DataFrame, live: DataFrame, ranks: DataFrame | None, compat: str = "default", boost: str = "code", stats: str = "code", corpus: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Boosted scores (doc_id, score) of a free-text or quoted query, and its terms."""
    if query is None or not query.strip():
        raise ValueError("the query is blank")
    candidates, terms = None, distinct_terms(query)
    if is_phrase(query):
        ordered = phrase_terms(query[1:-1], compat)
        if len(set(ordered)) >= 2:
            candidates = phrase_matches(postings, ordered, None if compat == "code" else live)
    scores = bm25f(postings, lengths, live, terms, candidates, stats, corpus)
    return (scores if ranks is None else link_boost(scores, ranks, boost)), terms


def envelope(query: str, results: DataFrame, took_ms: int | None = None) -> DataFrame:
    """One row of JSON: the query, how many results, how long it took, and the results in order."""
    rows = results.select(F.struct("score", "url", "title", "snippet").alias("r")).agg(F.sort_array(F.collect_list("r"), asc=False).alias("rs"))
    listed = F.transform("rs", lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"), r["score"].alias("score")))
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("rs").alias("resultCount"), F.lit(took_ms).cast("long").alias("tookMillis"), listed.alias("results"))).alias("response"))
