import json

import pytest
from pyspark.sql import functions as F

from spidex.operators import index, rank, search


@pytest.fixture(scope="module")
def guide(spark):
    rows = [("1", "Spark Guide", "spark sql makes fast joins and spark streams"), ("2", "Cooking", "fast food and fast joins of spark"), ("3", "Spark", "")]
    postings, lengths = index.build_segment(spark.createDataFrame(rows, "doc_id string, title string, text string"), 1)
    return postings.cache(), lengths.cache(), lengths.select("doc_id", "segment_id")


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def test_index(spark, guide):
    postings, lengths, _ = guide
    found = {(r.term, r.doc_id): (r.title_tf, r.text_tf, list(r.positions)) for r in postings.collect()}
    assert found["spark", "1"] == (1, 2, [0, 6]) and found["spark", "3"] == (1, 0, []) and found["fast", "2"] == (0, 2, [0, 3])
    assert {r.doc_id: (r.title_len, r.text_len) for r in lengths.collect()} == {"1": (2, 8), "2": (1, 7), "3": (1, 0)}
    stats = index.corpus_stats(lengths).first()
    assert (stats.total_docs, round(stats.avg_title_len, 6), stats.avg_text_len) == (3, 1.333333, 5.0)


def test_index_moves_texts_not_tokens(spark):
    pages = spark.createDataFrame([("1", "a", "b c")], "doc_id string, title string, text string")
    plan = index.build_segment(pages)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bm25f(guide):
    postings, lengths, live = guide
    assert scores(search.bm25f(postings, lengths, live, ["spark"])) == {"1": 0.097034, "3": 0.091304, "2": 0.045265}
    assert scores(search.bm25f(postings, lengths, live, search.distinct_terms("fast joins"))) == {"2": 0.3973, "1": 0.296065}
    assert scores(search.bm25f(postings, lengths, live, search.distinct_terms("FAST fast zebra"))) == {"2": 0.237977, "1": 0.148033}
    for q in ('"!!"', "!!"):
        assert scores(search.search(q, postings, lengths, live, None)[0]) == {}
    with pytest.raises(ValueError):
        search.search("  ", postings, lengths, live, None)


def test_only_live_copies_score(spark):
    old = index.build_segment(spark.createDataFrame([("a", "", "x y"), ("b", "", "x z")], "doc_id string, title string, text string"), 1)
    new = index.build_segment(spark.createDataFrame([("b", "", "q z")], "doc_id string, title string, text string"), 2)
    postings, lengths = (x.unionByName(y) for x, y in zip(old, new))
    live = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, segment_id long")
    code, alive = (scores(search.bm25f(postings, lengths, live, ["x"], stats=s)) for s in ("code", "live"))
    assert code.keys() == alive.keys() == {"a"} and code != alive
    # 3 copies with df 2, against 2 documents with df 1
    assert code["a"] < alive["a"]


PHRASES = [("1", "exact phrase here"), ("2", "phrase exact here"), ("3", "new york"), ("4", "new new york"), ("5", "exact filler phrase")]


@pytest.mark.parametrize(
    ("phrase", "default", "code"), [("exact phrase", {"1"}, {"2"}), ("new york", {"3", "4"}, {"3", "4"}), ("new new york", {"4"}, {"3", "4"}), ("phrase", {"1", "2", "5"}, {"1", "2", "5"})]
)
def test_phrases(spark, phrase, default, code):
    pages = spark.createDataFrame([(d, "york phrase", t) for d, t in PHRASES] + [("6", "exact phrase", "nothing")], "doc_id string, title string, text string").withColumn("title", F.when(F.col("doc_id") == "6", F.col("title")))
    postings, lengths = index.build_segment(pages, 1)
    live = lengths.select("doc_id", "segment_id")
    for compat, expected in (("default", default), ("code", code)):
        found = scores(search.search(f'"{phrase}"', postings, lengths, live, None, compat=compat)[0])
        assert found.keys() - {"6"} == expected
        assert ("6" in found) == (phrase == "phrase")


def test_stale_phrase(spark):
    make = lambda rows, s: index.build_segment(spark.createDataFrame(rows, "doc_id string, title string, text string"), s)
    postings, lengths = (x.unionByName(y) for x, y in zip(make([("a", "", "of the")], 1), make([("a", "", "the of")], 2)))
    live = spark.createDataFrame([("a", 2)], "doc_id string, segment_id long")
    assert scores(search.search('"of the"', postings, lengths, live, None)[0]) == {}
    terms = search.phrase_terms("the of", "code")
    assert terms == ["the", "of"]
    assert scores(search.search('"of the"', postings, lengths, live, None, compat="code")[0]).keys() == {"a"}


def test_link_boost(spark):
    base = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 1.0), ("4", 1.0)], "doc_id string, score double")
    ranks = spark.createDataFrame([("1", 2.0), ("2", 0.5), ("4", 1.0)], "page_id string, score double")
    assert scores(search.link_boost(base, ranks)) == {"1": 1.0, "2": 0.5, "3": 0.5, "4": 0.75}
    assert scores(search.link_boost(base, ranks, boost="documented")) == {"1": 1.5, "2": 1.0, "3": 1.0, "4": 1.25}
    assert set(scores(search.link_boost(base, rank.empty_ranks(spark))).values()) == {1.0}
    assert set(scores(search.link_boost(base, ranks.limit(1))).values()) == {1.0}


def test_results(spark):
    found = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "doc_id string, score double")
    pages = spark.createDataFrame([("a", "u:a", "A", "x y"), ("b", "u:b", "B", "y")], "doc_id string, url string, title string, text string")
    top = search.top_results(found, pages, ["x"], 2)
    assert [tuple(r) for r in top.collect()] == [("u:a", "A", "...x y...", 1.0)]
    body = json.loads(search.envelope("x", top, 5).first()[0])
    assert body == {"query": "x", "resultCount": 1, "tookMillis": 5, "results": [{"url": "u:a", "title": "A", "snippet": "...x y...", "score": 1.0}]}
    assert [search.clamp_limit(x) for x in (None, 0, 7, 99)] == [10, 1, 7, 50]


def test_pagerank(spark):
    v = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    e = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("C", "X"), ("C", None)], "src string, dst string")

    def run(**how):
        return {r.id: round(r.score, 6) for r in rank.pagerank(v, e, **how).collect()}

    assert run(max_iter=1, tolerance=0) == {"A": 0.291667, "B": 0.291667, "C": 0.575, "X": 0.141667}
    assert run(max_iter=2, tolerance=0) == {"A": 0.394375, "B": 0.273958, "C": 0.521875, "X": 0.244375}
    assert run() == {"A": 0.402403, "B": 0.321021, "C": 0.593889, "X": 0.252403}
    assert rank.pagerank(v.limit(0), e).count() == 0
    lone = {r.id: round(r.score, 6) for r in rank.pagerank(spark.createDataFrame([("Z",)], "id string"), e).collect()}
    assert lone["Z"] == 0.15


def test_terms_are_grouped_within_a_document(spark):
    """Rows of one id are merged, a null id's too; a task never has a table of (document, term)."""
    rows = [(1, "b a", "a b a"), (2, None, ""), (1, "c", "b, a"), (None, "x", None), (None, "x", "x"), (3, "", "z" * 70000 + " z")] + [(k, "t", "w0 w1 w0") for k in range(10, 600)]
    made = index.build_segment(spark.createDataFrame(rows, "doc_id long, title string, text string"), 7)
    analysed = index.postings(index.analysed(spark.createDataFrame(rows, "doc_id long, title string, text string")), 7)
    want = {}
    for doc_id, title, text in rows:
        for term in (title or "").split():
            want.setdefault((term, doc_id), [0, []])[0] += 1
        for k, term in enumerate((text or "").replace(",", "").split()):
            want.setdefault((term, doc_id), [0, []])[1].append(k)
    for postings in (made[0], analysed):
        got = {(r.term, r.doc_id): [r.title_tf, r.positions] for r in postings.collect()}
        assert got == {k: [n, sorted(p)] for k, (n, p) in want.items()} and postings.filter("size(positions) <> text_tf or segment_id <> 7").isEmpty()
        plan = postings._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate" in line and "term" in line.split("]")[0]]
