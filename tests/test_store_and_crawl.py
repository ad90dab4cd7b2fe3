import datetime as dt

import pytest
from pyspark.sql import functions as F

from spidex import schemas
from spidex.api import Engine
from spidex.operators import frontier, index, segments
from spidex.operators.segments import SegmentStore
from spidex.streaming.ingest import index_stream, unseen_stream



def now():
    return F.expr("TIMESTAMP '2024-01-01 00:00:00'")


T0 = dt.datetime(2024, 1, 1)


def make(spark, rows, segment):
    return index.build_segment(spark.createDataFrame(rows, "doc_id string, title string, text string"), segment)


@pytest.fixture
def store(spark, tmp_path):
    s = SegmentStore(spark, f"file://{tmp_path}/index")
    s.flush(*make(spark, [("a", "t", "one x"), ("b", "t", "two old"), ("c", "t", "three")], 1))
    s.flush(*make(spark, [("b", "t", "two new"), ("d", "t", "four")], 2))
    s.forget(spark.createDataFrame([("c",)], "doc_id string"))
    return s


def location(s):
    return {r.doc_id: r.segment_id for r in s.location().collect()}


def test_flush_and_live_copies(spark, store):
    assert location(store) == {"a": 1, "b": 2, "d": 2} and store.ids() == [1, 2]
    store.validate()
    postings, lengths = store.active()
    assert lengths.count() == 5 and {tuple(r) for r in postings.filter("term = 'old'").select("segment_id", "doc_id").collect()} == {(1, "b")}
    assert store.flush(*make(spark, [("z", "", "")], 9)[:1], lengths.limit(0)) is None and store.next_id() == 3
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,old)]" in postings.filter("term = 'old'")._jdf.queryExecution().executedPlan().toString()


def test_merge(spark, store):
    assert store.maybe_merge(3) is None
    held = store.active()[1]
    assert store.maybe_merge(2) == {"segment_id": 3, "documents": 3, "stale_copies": 2}
    assert location(store) == {"a": 3, "b": 3, "d": 3} and store.ids() == [3]
    postings, lengths = store.active()
    assert {r.doc_id for r in lengths.collect()} == {"a", "b", "d"} and postings.filter("term in ('old', 'three')").isEmpty()
    assert held.columns == ["segment_id", "doc_id", "title_len", "text_len"]
    store.validate()


def test_merge_of_stale_copies_only(spark, store):
    store.forget(spark.createDataFrame([("a",), ("b",), ("d",)], "doc_id string"))
    assert store.maybe_merge(2)["documents"] == 0 and store.ids() == [3]


def test_recovery_and_reset(spark, store, tmp_path):
    for name in ("segment_id=11", "junk", "segment_id=12.tmp"):
        (tmp_path / "index/postings" / name).mkdir()
    again = SegmentStore(spark, f"file://{tmp_path}/index")
    assert sorted(p.name for p in (tmp_path / "index/postings").iterdir()) == ["junk", "segment_id=1", "segment_id=2"]
    assert again.next_id() == 3
    again._publish([1], [(2, 7)])
    with pytest.raises(ValueError, match="documents"):
        again.validate()
    again.tables.write("segments_meta", again.meta().withColumn("format_version", F.lit(2)))
    with pytest.raises(ValueError, match="format"):
        again.validate()
    again.reset()
    assert again.ids() == [] and location(again) == {} and again.next_id() == 1 and again.active()[0].isEmpty()


def test_numeric_order(spark, tmp_path):
    s = SegmentStore(spark, f"file://{tmp_path}/index")
    for k in (9, 10):
        s.flush(*make(spark, [(str(k), "", "x")], k), segment_id=k)
    assert s.ids() == [9, 10] and s.next_id() == 11


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in segments.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in segments.latest(old.union(new), ["k"], "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def queue(spark, rows):
    """rows (id, domain_id, created second, attempts, retry second or None)."""
    frame = spark.createDataFrame([(str(i), f"https://h{d}.test/{i}", d, None if r is None else T0 + dt.timedelta(seconds=r), a, None, T0 + dt.timedelta(seconds=c), T0) for i, d, c, a, r in rows], schemas.PENDING_CRAWL)
    return frame


def domains(spark, rows):
    """rows (id, name, seconds until available, max_pages, pages_crawled)."""
    return spark.createDataFrame([(i, n, T0 + dt.timedelta(seconds=s), 500, m, c, T0, T0) for i, n, s, m, c in rows], schemas.DOMAIN)


def test_fair_queue(spark):
    rows = [(k, 1, 10 - k, 0, None) for k in range(7)] + [(10, 2, 0, 0, None), (11, 2, 1, 2, 0), (12, 3, 0, 0, None), (13, 2, 0, 3, None), (14, 2, 0, 0, 5), (15, 99, 0, 0, None)]
    due = frontier.due_urls(queue(spark, rows), domains(spark, [(1, "a", 0, 9, 0), (2, "b", 0, 9, 0), (3, "c", 60, 9, 0)]), now())
    assert {r.id for r in due.collect()} == {"2", "3", "4", "5", "6", "10", "11"}
    assert "WindowGroupLimit" in due._jdf.queryExecution().executedPlan().toString()


def test_retry(spark):
    rows = frontier.retry(queue(spark, [(k, 1, 0, k, None) for k in range(3)]), now()).orderBy("id").collect()
    assert [((r.retry_after - T0).total_seconds(), r.attempt_count) for r in rows] == [(0, 1), (2, 2), (4, 3)]


def link_rows(spark, rows):
    return spark.createDataFrame(rows, "source_page_id string, ord int, href string, anchor string")


def test_page_links(spark):
    many = [("p", k, f"https://x.test/{k}", "") for k in range(250)]
    assert frontier.page_links(link_rows(spark, many)).agg(F.count("*"), F.max("ord")).first() == (200, 199)
    found = frontier.page_links(link_rows(spark, [("p", 0, "https://x.test/a#1", "x"), ("p", 1, "https://x.test/a", "y"), ("p", 2, "http://x.test/b", "z"), ("p", 3, "https://x.test/b.pdf", "")]))
    assert [(r.target_url, r.anchor_text) for r in found.collect()] == [("https://x.test/a", "x")]


def state_of(spark, pending, domain, seen=()):
    none = lambda s: spark.createDataFrame([], s)
    return frontier.Frontier(pending, domain, none(schemas.PAGE_METADATA), none(schemas.PAGE_LINK), spark.createDataFrame([(u,) for u in seen], schemas.SEEN_URLS))


def test_enqueue(spark):
    rows = [("p", k, f"https://a.test/{k}", str(k)) for k in range(4)] + [("p", 9, "https://full.test/x", ""), ("p", 10, "https://new.test/y", ""), ("p", 11, "https://a.test/seen", ""), ("p", 12, "https://new.test/no", "")]
    state = state_of(spark, queue(spark, []), domains(spark, [(1, "a.test", 0, 5, 3), (2, "full.test", 0, 5, 5)]), ["https://a.test/seen"])
    files = spark.createDataFrame([("new.test", 200, "User-agent: *\nDisallow: /no", T0)], "host string, status int, body string, fetched_at timestamp")
    after = frontier.enqueue(state, frontier.page_links(link_rows(spark, rows)), files, now())
    assert {r.url for r in after.pending.collect()} == {"https://a.test/0", "https://a.test/1", "https://new.test/y"}
    d = {r.domain_name: r for r in after.domain.collect()}
    assert (d["a.test"].pages_crawled, d["full.test"].pages_crawled, d["new.test"].pages_crawled) == (5, 5, 1)
    assert (d["new.test"].crawl_delay_ms, d["new.test"].max_pages) == (500, 5000)
    assert d["a.test"].next_available_at == T0 + dt.timedelta(milliseconds=500) and d["full.test"].next_available_at == T0
    linked = {r.target_url: r.target_page_id for r in after.links.collect()}
    assert linked["https://a.test/0"] and linked["https://a.test/seen"] is None and len(linked) == 8


def page_rows(spark):
    rows = [(str(k), f"https://a.test/{k}", 1, "T", "old", "D", "C", 200, "fr", None, T0, "INDEXED", T0, T0 - dt.timedelta(days=8 if k < 4 else 1)) for k in range(5)]
    return spark.createDataFrame(rows, schemas.PAGE_METADATA).withColumn("content_hash", F.sha2("text", 256))


def test_recrawl(spark):
    answers = [("https://a.test/0", 200, "text/html", "<p>old</p>"), ("https://a.test/1", 200, "text/html; x", "<html lang=en><title>N</title><p>new</p>"), ("https://a.test/2", 500, "text/html", "x"), ("https://a.test/3", 200, "image/png", "x"), ("https://a.test/4", 200, "text/html", "x")]
    fetched = spark.createDataFrame(answers, "url string, status int, content_type string, html string")
    r = {x.id: x for x in frontier.recrawl(page_rows(spark), fetched, now()).collect()}
    assert (r["0"].updated_at, r["0"].index_status, r["0"].text) == (T0, "INDEXED", "old")
    assert (r["1"].title, r["1"].text, r["1"].index_status, r["1"].language, r["1"].canonical_url) == ("N", "new", "PENDING", "fr", "C")
    for k in "234":
        assert r[k].text == "old" and r[k].updated_at < T0


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    e.seed({"a.test": ["https://a.test/", "https://a.test/gone", "https://a.test/no"]}, now())
    page = lambda t, links: f"<html lang=en><title>{t}</title><body>of the {t} " + "".join(f'<a href="{u}">{u}</a>' for u in links)
    fetched = spark.createDataFrame([("https://a.test/", 200, "text/html", page("home", ["/x", "/y"])), ("https://a.test/x", 200, "text/html", page("inner", ["/"])), ("https://a.test/y", 200, "text/html", page("other", ["/", "/x"]))], "url string, status int, content_type string, html string")
    files = spark.createDataFrame([("a.test", 200, "User-agent: *\nDisallow: /no", T0)], "host string, status int, body string, fetched_at timestamp")
    first = {r.url: r.status for r in e.crawl_step(fetched, files, now()).collect()}
    assert first == {"https://a.test/": "done", "https://a.test/gone": "retry", "https://a.test/no": "disallowed"}
    later = F.expr("TIMESTAMP '2024-01-01 00:01:00'")
    assert {r.url: r.status for r in e.crawl_step(fetched, files, later).collect()} == {"https://a.test/x": "done", "https://a.test/y": "done", "https://a.test/gone": "retry"}
    assert e.index_batch() == 1 and e.index_batch() is None
    assert {r.title for r in e.search("the home").collect()} == {"home", "inner", "other"}
    assert e.search("home").first().title == "home"
    assert [r.title for r in e.phrase_search("the inner").collect()] == ["inner"]
    ranks = e.page_rank(max_iter=5)
    assert ranks.count() == 3 and e.search("the").count() == 3
    assert e.respond("home").count() == 1
    assert e.merge(1)["documents"] == 3 and e.search("home").first().title == "home"
    e.recrawl(fetched, F.expr("TIMESTAMP '2024-02-01 00:00:00'"))
    e.reset_index()
    assert e.search("home").isEmpty() and e.tables.read("page_metadata").filter("index_status = 'PENDING'").count() == 3 and e.tables.read("page_rank").count() == 3
    e.clear_seen()
    assert e.tables.read("seen_urls").isEmpty()


def test_streaming(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/index")
    inbox = tmp_path / "in"
    schema = "doc_id string, title string, text string, version int"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{inbox}")

    def drain():
        q = index_stream(spark.readStream.schema(schema).parquet(f"file://{inbox}"), store, first_segment=1, order="version").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(("a", "", "x", 1), ("a", "", "y", 2), ("b", "", "z", 1))
    drain()
    arrive(("b", "", "w", 2))
    drain()
    assert store.ids() == [1, 2] and location(store) == {"a": 1, "b": 2}
    assert {r.term for r in store.active()[0].filter("doc_id = 'a'").collect()} == {"y"}
    urls = unseen_stream(spark.readStream.schema(schema).parquet(f"file://{inbox}"), "doc_id")
    q = urls.writeStream.format("memory").queryName("seen_once").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from seen_once").count() == 2


def test_streaming_with_merges_and_replays(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/index")
    inbox = tmp_path / "in"
    schema = "doc_id string, title string, text string"

    def drain(k):
        spark.createDataFrame([(f"d{k}", "", f"word{k} all")], schema).coalesce(1).write.mode("append").parquet(f"file://{inbox}")
        index_stream(spark.readStream.schema(schema).parquet(f"file://{inbox}"), store, merge_at=3).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    for k in range(4):
        drain(k)
    # the third batch merged 1, 2 and 3 into 4, so the fourth is 5
    assert store.ids() == [4, 5] and location(store) == {"d0": 4, "d1": 4, "d2": 4, "d3": 5}
    stream, batch = store.tables.read("stream_batches").select("stream", "batch_id").first()
    assert store.flush_batch(stream, batch, *make(spark, [("other", "", "x")], 1)) is None and "other" not in location(store)
    # a batch that ended between its note and its manifest is written again under the id it had, though a merge came between
    store._note("s", 7, store.next_id(), False)
    assert store.next_id() == 7 and store.maybe_merge(2)["segment_id"] == 7
    assert store.flush_batch("s", 7, *make(spark, [("late", "", "x")], 1)) == 6
    assert location(store) == {"d0": 7, "d1": 7, "d2": 7, "d3": 7, "late": 6} and store.next_id() == 8
    store.validate()
    assert {r.doc_id for r in store.active()[0].filter("term = 'all'").collect()} == {"d0", "d1", "d2", "d3"}


def test_a_segment_is_not_overwritten(spark, store):
    with pytest.raises(FileExistsError):
        store.flush(*make(spark, [("q", "", "x")], 1), segment_id=1)
    with pytest.raises(FileExistsError):
        store.replace([1, 2], 2)
    assert store.flush(*make(spark, [("q", "", "x")], 1), segment_id=1, again=True) == 1
    stats = store.corpus().first()
    assert (stats.total_docs, stats.avg_title_len) == (3, 2 / 3) and stats.avg_text_len == 4 / 3


def test_postings_that_do_not_fit_are_found(spark, store):
    postings, lengths = make(spark, [("q", "", "x y z")], 1)
    store.flush(postings.filter("term <> 'y'"), lengths)
    with pytest.raises(ValueError, match="postings"):
        store.validate()


def test_robots_to_fetch(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    e.seed({d: [f"https://{d}/"] for d in ("a.test", "b.test", "c.test")}, now())
    files = spark.createDataFrame([("a.test", 200, "", T0), ("b.test", 200, "", T0 - dt.timedelta(hours=25))], "host string, status int, body string, fetched_at timestamp")
    assert {r.host for r in e.robots_to_fetch(files, now()).collect()} == {"b.test", "c.test"}


def test_postings_are_dealt_by_document_to_sorted_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PART_TOKENS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = SegmentStore(spark, f"file://{tmp_path}/index")
    for k in range(2):
        s.flush(*make(spark, [(f"d{n}", "t", f"all w{n} v{k}") for n in range(k * 40, 120)], 1))
    s.forget(spark.createDataFrame([("d0",)], "doc_id string"))
    assert s.maybe_merge(2)["documents"] == 119 and spark.conf.get("spark.sql.shuffle.partitions") == before
    s.validate()
    files = s.active()[0].select("term", "doc_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    assert 3 <= len({r.file for r in files}) <= 5  # 476 tokens; the word that all have is in each file
    assert {r.file for r in files if r.term == "all"} == {r.file for r in files} and all(len({r.file for r in files if r.doc_id == d}) == 1 for d in ("d1", "d50", "d119"))
    for f in {r.file for r in files}:
        rows = [(r.term, r.doc_id) for r in files if r.file == f]
        assert rows == sorted(rows)
