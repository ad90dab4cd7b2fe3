import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spidex.functions import html, robots, text, urls

BODY = """User-agent: *
Disallow: /private
Crawl-delay: 0.5

User-agent: SpidexBot   # ours
Disallow: /tmp*
Allow: /tmp/ok

User-agent: *
Disallow: /late
"""


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}").orderBy("k").select(column).collect()]


def test_tokens(spark):
    given_ = [None, "", "  \t ", "Hello, World-2 x", "für e-mail", "A a A", "İx", "K"]
    expected = [[], [], [], ["hello", "world", "2", "x"], ["f", "r", "e", "mail"], ["a", "a", "a"], ["i", "x"], ["k"]]
    assert values(spark, given_, "string", text.tokens("v")) == expected
    assert [text.tokenize(x) for x in given_[:6]] == expected[:6]


def test_snippet(spark):
    words = " ".join(f"w{k}" for k in range(25))

    def cut(a, b):
        return "..." + " ".join(f"w{k}" for k in range(a, b + 1)) + "..."

    def one(t, terms):
        return values(spark, [t], "string", text.snippet("v", terms))[0]

    assert one(words, ["w10"]) == cut(2, 21)
    assert one(words, ["w3"]) == cut(0, 14)
    assert one(words, ["w24"]) == cut(16, 24)
    assert one(words, ["zzz"]) == " ".join(f"w{k}" for k in range(20))
    assert [one(t, ["a"]) for t in (None, "", "   ")] == ["", "", ""]
    assert one("Send e-mail now", ["e", "mail"]) == "Send e-mail now"
    assert one('"Spark," he said', ["spark"]) == '..."Spark," he said...'
    assert one("  lead in", ["in"]) == "... lead in..."


CANONICAL = {
    "http://ththre.example.com/fr/825?page=2&ref=x": "http://ththre.example.com/fr/825?page=2",
    "https://m.ththth.example.net/en/25#top": "https://m.ththth.example.net/en/25",
    "https://ththin.example.com/en/671?utm_source=feed": "https://ththin.example.com/en/671",
    "https://blog.tionsh.example.net/es/533/": "https://blog.tionsh.example.net/es/533/",
    "https://Example.COM:443": "https://example.com/",
    "http://example.com:8080/a/../b": "http://example.com:8080/b",
    "https://u:p@example.com/": "https://example.com/",
    "https://example.com/?b=2&a=1&UTM_Source=z": "https://example.com/?a=1&b=2",
    "https://example.com/?a=1&b=1&c=1&d=1&e=1": "https://example.com/?a=1&b=1&c=1&d=1&e=1",
    "https://example.com/?a=1&b=1&c=1&d=1&e=1&f=1": None,
    "https://example.com/x.PDF": None,
    "https://example.com/a/b/a": "https://example.com/a/b/a",
    "https://example.com/a/b/a/c/a": None,
    "https://example.com/1/2/3/4/5/6/7/8/9": "https://example.com/1/2/3/4/5/6/7/8/9",
    "https://example.com/1/2/3/4/5/6/7/8/9/10": None,
    "HTTP://example.com/": None,
    "ftp://example.com/": None,
    "/rel": None,
    None: None,
    "   ": None,
    "https://example.com/" + "x" * 236: None,
    "https://example.com/?=": None,
    "https://example.com/a b": None,
    "https://example.com/a%20b": "https://example.com/a%20b",
    "https://under_score.com/": None,
}


def test_canonical_urls(spark):
    assert {u: urls.canonical(u) for u in CANONICAL} == CANONICAL
    assert values(spark, list(CANONICAL), "string", urls.normalize_url("v")) == list(CANONICAL.values())


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,5}\.com(/[a-z.]{0,4}){0,5}(\?[a-z=&]{0,9})?(#x)?", fullmatch=True))
def test_canonical_is_stable(url):
    once = urls.canonical(url)
    assert once is None or urls.canonical(once) == once


def test_hosts(spark):
    assert values(spark, ["https://Foo.com/x", "no url", None, "http://[bad"], "string", urls.host_of("v")) == ["foo.com", None, None, None]


def test_segments_and_assets(spark):
    assert values(spark, ["/a/b/a", "/a/a/a", "//x//"], "string", urls.repeats_a_segment("v")) == [False, True, False]
    assert values(spark, ["/x.pdf", "/x.PNG", "/x.html"], "string", urls.has_asset_extension("v")) == [True, True, False]


def test_safety(spark):
    rows = ["https://ok.test/", "http://ok.test/", "https://localhost/", "https://169.254.169.254/", "https://metadata.google.internal/", "https://inner.test/", "https://none.test/", "https://meta.test/", None, "x"]
    dns = spark.createDataFrame([("ok.test", "93.184.216.34"), ("inner.test", "93.184.216.34"), ("inner.test", "10.0.0.1"), ("localhost", "127.0.0.1"), ("meta.test", "169.254.169.254")], "host string, ip string")
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, url string")
    found = [r.safe for r in urls.with_safety(frame, dns).orderBy("k").collect()]
    assert found == [True] + [False] * 9
    assert [r.safe for r in urls.with_safety(frame).orderBy("k").collect()] == [True, False, False, False, False, True, True, True, False, False]


@pytest.mark.parametrize("ip", ["127.0.0.1", "10.0.0.1", "192.168.1.1", "169.254.1.1", "0.0.0.0", "224.0.0.1", "100.64.0.1", "fd00::1", "::1", "x", None, "169.254.169.254"])
def test_blocked(ip):
    assert urls.blocked(ip)


@pytest.mark.parametrize("ip", ["100.128.0.1", "93.184.216.34", "2606:2800:220:1::1"])
def test_public(ip):
    assert not urls.blocked(ip)


def test_robots(spark):
    rules = robots.parse(BODY)
    assert rules == {"disallow": ["/private", "/tmp*"], "allow": ["/tmp/ok"], "crawl_delay_s": 0}
    paths = ["/private/x", "/tmpfile", "/tmp/ok/1", "/late", "/"]
    frame = spark.createDataFrame([(k, p, BODY) for k, p in enumerate(paths)], "k int, path string, body string")
    got = frame.withColumn("r", robots.parse_robots("body")).orderBy("k").select(robots.robots_allowed("r", "path").alias("a"), robots.crawl_delay_ms("r").alias("d")).collect()
    assert [r.a for r in got] == [False, False, True, True, True]
    assert {r.d for r in got} == {500}
    assert robots.parse("User-agent: *\nDisallow:\nDisallow: /a*b\nCrawl-delay: abc") == {"disallow": ["/a*b"], "allow": [], "crawl_delay_s": None}
    assert robots.parse("User-agent: *\nCrawl-delay: 2")["crawl_delay_s"] == 2
    assert robots.parse(None) == robots.parse(" ") == {"disallow": [], "allow": [], "crawl_delay_s": None}


def test_robots_of_hosts(spark):
    now = F.expr("TIMESTAMP '2024-01-02 12:00:00'")
    files = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /"), ("b", 404, "User-agent: *\nDisallow: /"), ("c", None, None)], "host string, status int, body string")
    files = files.withColumn("fetched_at", F.when(F.col("host") == "a", F.expr("TIMESTAMP '2024-01-01 00:00:00'")).otherwise(now))
    hosts = spark.createDataFrame([(h,) for h in "abcd"], "host string")
    rows = {r.host: r for r in robots.robots_for(hosts, files, now).withColumn("ok", robots.robots_allowed("rules", F.lit("/x"))).collect()}
    assert {h: r.ok for h, r in rows.items()} == {"a": False, "b": True, "c": True, "d": True}
    assert {h: r.stale for h, r in rows.items()} == {"a": True, "b": False, "c": False, "d": True}


def test_html(spark):
    page = """<!doctype html><html lang="fr"><head><title> A &amp;
      B </title><meta name="Description" content="d"><link rel="canonical" href="/c"><style>x{}</style></head>
      <body><script>no()</script><p>one</p><p>two <b>th</b>ree</p><a href="/x?y=1">go <i>on</i></a><a>none</a><a href="z">last</a></body></html>"""
    p = html.parse_page(page, "https://h.test/dir/p")
    assert p["title"] == "A & B" and p["text"] == "one two three go onnonelast" and p["description"] == "d"
    assert p["canonical_url"] == "https://h.test/c" and p["language"] == "fr"
    assert p["links"] == [{"ord": 0, "href": "https://h.test/x?y=1", "anchor": "go on"}, {"ord": 1, "href": "https://h.test/dir/z", "anchor": "last"}]
    frame = spark.createDataFrame([(page, "https://h.test/dir/p"), (None, None), ("", "x"), ("<p>broken <", "http://h.test/")], "html string, url string")
    rows = [r.p for r in frame.select(html.parse_html("html", "url").alias("p")).collect()]
    assert rows[0].title == "A & B" and len(rows[0].links) == 2 and rows[1].text == rows[2].text == "" and rows[3].text.startswith("broken")


def test_written_out_addresses(spark):
    bad = "10.0.0.5 192.168.1.1 127.0.0.2 172.31.0.1 100.64.0.1 224.0.0.1 0.1.2.3 300.1.1.1 010.8.8.8 2130706433 0x7f.1 127.1 [fd00::1] [::1] [fe80::1] [::ffff:10.0.0.1] localhost.localdomain ip6-loopback localhost."
    good = "8.8.8.8 100.128.0.1 172.32.0.1 [2606:2800::1] [::ffff:8.8.8.8] a1.test 1a.test"
    rows = [(h, False) for h in bad.split()] + [(h, True) for h in good.split()]
    df = urls.with_safety(spark.createDataFrame([(f"https://{h}/x", ok) for h, ok in rows], "url string, ok boolean"))
    assert df.filter("safe <> ok").select("url").collect() == []


def test_robots_see_decoded_paths(spark):
    rows = spark.createDataFrame([("https://x.test/a%20b/c",), ("https://x.test/a+b",), ("https://x.test/%zz",), ("https://x.test",)], "url string")
    assert [r.p for r in rows.select(urls.path_of("url").alias("p")).collect()] == ["/a b/c", "/a+b", "/", "/"]  # the third is no URL


def test_bodies_are_read_to_two_mebibytes():
    page = html.parse_page("é" * (html.LARGEST // 2) + "more", None)
    assert len(page["text"]) == html.LARGEST // 2 and html.capped("short é") == "short é"


def test_references_without_a_semicolon():
    page = "<title>a&amp&amp;b&am</title><body>x&amp; &amp y&#38 <a href='/q?a=1&lt=2'>z&lt;&gt</a>"
    p = html.parse_page(page, "https://h.test/")
    assert (p["title"], p["text"], p["links"][0]["anchor"]) == ("a&&b&am", "x& & y& z<>", "z<>")
    p = html.parse_page(page, "https://h.test/", bare=False)
    assert (p["title"], p["text"], p["links"][0]["anchor"]) == ("a&amp&b&am", "x& &amp y&#38 z<&gt", "z<&gt")
    assert p["links"][0]["href"] == "https://h.test/q?a=1&lt=2"


def test_pages_are_parsed_a_few_at_a_time():
    pages, read = [f"<title>{k}</title>" for k in range(2 * html.AT_ONCE + 1)] + [None], []

    def batches():
        for k in range(2):
            read.append(k)
            yield pa.array(pages), pa.array([None] * len(pages), pa.string())

    rows = html.parsed_pages(batches())
    assert len(next(rows)) == html.AT_ONCE and read == [0]
    assert [len(x) for x in rows] == [html.AT_ONCE, 2, html.AT_ONCE, html.AT_ONCE, 2]
    assert [x["title"] for out in html.parsed_pages(batches()) for x in out.to_pylist()] == 2 * [*map(str, range(2 * html.AT_ONCE + 1)), ""]
