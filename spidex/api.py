"""The engine as one object: crawl, index, rank and search over tables in one folder."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spidex import schemas
from spidex.functions.robots import stale_hosts
from spidex.functions.urls import host_of
from spidex.operators import frontier, rank, search
from spidex.operators.index import build_segment
from spidex.operators.lineage import cut
from spidex.operators.segments import MERGE_AT, SegmentStore, TableStore, upsert
from spidex.sources.tables import seed_rows

_TABLES = {"page_metadata": schemas.PAGE_METADATA, "pending_crawl": schemas.PENDING_CRAWL, "domain": schemas.DOMAIN, "page_link": schemas.PAGE_LINK, "page_rank": schemas.PAGE_RANK, "seen_urls": schemas.SEEN_URLS}
_OF_FRONTIER = {"pending": "pending_crawl", "domain": "domain", "pages": "page_metadata", "links": "page_link", "seen": "seen_urls"}


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = TableStore(spark, root, _TABLES)
        self.segments = SegmentStore(spark, f"{root.rstrip('/')}/index")

    @staticmethod
    def _now(now: Column | None) -> Column:
        """One moment for all jobs of a step."""
        return F.timestamp_micros(F.lit(time.time_ns() // 1000)) if now is None else now

    def seed(self, seeds: dict[str, list[str]], now: Column | None = None) -> None:
        domains, queue = seed_rows(self.spark, seeds, self._now(now))
        self.tables.write("domain", upsert(self.tables.read("domain"), domains, ["domain_name"]))
        self.tables.write("pending_crawl", upsert(self.tables.read("pending_crawl"), queue, ["id"]))

    def robots_to_fetch(self, robots: DataFrame, now: Column | None = None) -> DataFrame:
        """(host) whose robots file the next crawl_step needs anew: due hosts without one, or with one older than a day."""
        now = self._now(now)
        due = frontier.due_urls(self.tables.read("pending_crawl"), self.tables.read("domain"), now)
        return stale_hosts(due.select(host_of("url").alias("host")), robots, now)

    def crawl_step(self, fetched: DataFrame, robots: DataFrame, now: Column | None = None, dns: DataFrame | None = None) -> DataFrame:
        """One turn; (id, url, status) of the rows whose turn it was."""
        state = frontier.Frontier(**{k: self.tables.read(t) for k, t in _OF_FRONTIER.items()})
        after = frontier.crawl_step(state, fetched, robots, self._now(now), dns)
        outcome = cut(after.outcome)
        staged = {t: cut(getattr(after, k)) for k, t in _OF_FRONTIER.items()}
        for name, rows in staged.items():
            self.tables.write(name, rows)
        return outcome

    def recrawl(self, fetched: DataFrame, now: Column | None = None, cutoff: Column | None = None) -> None:
        self.tables.write("page_metadata", frontier.recrawl(self.tables.read("page_metadata"), fetched, self._now(now), cutoff))

    def index_batch(self, limit: int = 500) -> int | None:
        """Index pages that wait; the new segment, or None without any."""
        pages = self.tables.read("page_metadata")
        batch = cut(frontier.pending_pages(pages, limit))
        made = self.segments.flush(*build_segment(batch, key="id"))
        if made is not None:
            self.tables.write("page_metadata", upsert(pages, batch.withColumn("index_status", F.lit("INDEXED")), ["id"]))
        return made

    def merge(self, trigger: int = MERGE_AT) -> dict | None:
        return self.segments.maybe_merge(trigger)

    def page_rank(self, edges: str = "resolve_by_url", **how) -> DataFrame:
        """Recompute ranks; rows of pages that are gone stay."""
        pages, links = self.tables.read("page_metadata").select("id", "url"), self.tables.read("page_link")
        table = rank.edges_by_url(links, pages) if edges == "resolve_by_url" else rank.discovered_edges(links)
        new = rank.pagerank(pages.select("id"), table, **how).select(F.col("id").alias("page_id"), "score")
        self.tables.write("page_rank", upsert(self.tables.read("page_rank"), new, ["page_id"]))
        return self.tables.read("page_rank")

    def search(self, query: str, limit: int | None = None, **how) -> DataFrame:
        """(url, title, snippet, score): free text, or a phrase in double quotes."""
        postings, lengths = self.segments.active()
        scores, terms = search.search(query, postings, lengths, self.segments.location(), self.tables.read("page_rank"), corpus=self.segments.corpus(), **how)
        pages = self.tables.read("page_metadata").withColumnRenamed("id", "doc_id")
        return search.top_results(scores, pages, terms, search.clamp_limit(limit))

    def phrase_search(self, phrase: str, limit: int | None = None, **how) -> DataFrame:
        return self.search(f'"{phrase}"', limit, **how)

    def respond(self, query: str, limit: int | None = None, **how) -> DataFrame:
        """One row of JSON as a service would answer."""
        began = time.monotonic()
        hits = cut(self.search(query, limit, **how))  # MOST_LIMIT rows at most
        return search.envelope(query, hits, int(1000 * (time.monotonic() - began)))

    def reset_index(self) -> None:
        """No segments, no live copies, every page waits for indexing; ranks stay."""
        self.segments.reset()
        self.tables.write("page_metadata", frontier.reset_status(self.tables.read("page_metadata")))

    def clear_seen(self) -> None:
        self.tables.write("seen_urls", self.spark.createDataFrame([], schemas.SEEN_URLS))
