"""The crawl frontier: whose turn it is, what a fetched page adds to the queue, retries and recrawls."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.functions.html import parse_html
from spidex.functions.robots import crawl_delay_ms, robots_allowed, robots_for
from spidex.functions.text import changed, content_hash
from spidex.functions.urls import host_of, normalize_url, path_of, with_safety
from spidex.operators.lineage import cut
from spidex.operators.segments import delete_keys, upsert

PER_DOMAIN, MOST_ATTEMPTS, RETRY_STEP_MS = 5, 3, 2000
LINKS_PER_PAGE, PAGES_PER_DOMAIN = 200, 5000
RECRAWL_BATCH, RECRAWL_DAYS = 1000, 7


def later_by_ms(when: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(when) + ms)


def due(pending: DataFrame, now: Column, max_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    return pending.filter((F.col("retry_after").isNull() | (F.col("retry_after") <= now)) & (F.col("attempt_count") < max_attempts))


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; a window that drops the rest before it shuffles."""
    taken = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", taken).filter(F.col("_nth") <= n).drop("_nth")


def due_urls(pending: DataFrame, domain: DataFrame, now: Column, per_domain: int = PER_DOMAIN, max_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The oldest due rows of each domain that may be visited now, ``per_domain`` at most: filters, then the window, as one plan."""
    open_ = domain.filter(F.col("next_available_at") <= now).select(F.col("id").alias("domain_id"))
    return first_of_each(due(pending, now, max_attempts).join(open_, "domain_id", "left_semi"), "domain_id", ["created_at", "id"], per_domain)


def retry(pending: DataFrame, now: Column) -> DataFrame:
    """Failed rows: due again after 2 s times the attempts before this one."""
    return pending.withColumn("retry_after", later_by_ms(now, F.col("attempt_count") * RETRY_STEP_MS)).withColumn("attempt_count", F.col("attempt_count") + 1).withColumn("updated_at", now)


def pending_pages(pages: DataFrame, limit: int = 500) -> DataFrame:
    return pages.filter("index_status = 'PENDING'").orderBy("created_at", "id").limit(limit)


def recrawl_due(pages: DataFrame, cutoff: Column, limit: int = RECRAWL_BATCH) -> DataFrame:
    return pages.filter(F.col("updated_at") <= cutoff).orderBy("updated_at", "id").limit(limit)


def reset_status(pages: DataFrame) -> DataFrame:
    return pages.withColumn("index_status", F.lit("PENDING"))


def page_links(links: DataFrame, dns: DataFrame | None = None, per_page: int = LINKS_PER_PAGE) -> DataFrame:
    """(source_page_id, target_url, anchor_text, ord): safe links in canonical form, the first anchor of each, the first ``per_page`` of a page."""
    safe = with_safety(links, dns, "href").filter("safe").withColumn("target_url", normalize_url("href")).filter("target_url is not null")
    firsts = safe.groupBy("source_page_id", "target_url").agg(F.min_by("anchor", "ord").alias("anchor_text"), F.min("ord").alias("ord"))
    return first_of_each(firsts, "source_page_id", ["ord"], per_page)


def unseen(urls: DataFrame, seen: DataFrame, column: str = "url") -> DataFrame:
    """Exact: a URL that was never seen always passes."""
    return urls.join(seen.select(F.col("url").alias(column)), column, "left_anti")


def mark_seen(seen: DataFrame, urls: DataFrame) -> DataFrame:
    return seen.select("url").union(urls.select("url")).distinct()


def within_budget(candidates: DataFrame, domain: DataFrame) -> DataFrame:
    """candidates (host, url, place): of each host the first that its domain's budget has room for."""
    room = domain.select(F.col("domain_name").alias("host"), (F.col("max_pages") - F.col("pages_crawled")).alias("room"))
    nth = F.row_number().over(W.partitionBy("host").orderBy("place", "url"))
    return candidates.join(room, "host").filter("room > 0").withColumn("_nth", nth).filter("_nth <= room").drop("_nth", "room")


def new_domains(hosts: DataFrame, domain: DataFrame, now: Column) -> DataFrame:
    """Rows for hosts (host, rules) that have none yet."""
    fresh = hosts.join(domain.select(F.col("domain_name").alias("host")), "host", "left_anti")
    return fresh.select(
        F.xxhash64("host").alias("id"), F.col("host").alias("domain_name"), now.alias("next_available_at"), crawl_delay_ms("rules").alias("crawl_delay_ms"),
        F.lit(PAGES_PER_DOMAIN).alias("max_pages"), F.lit(0).alias("pages_crawled"), now.alias("created_at"), now.alias("updated_at"),
    )


def url_id(url: Column) -> Column:
    return F.sha2(url, 256)


@dataclass(frozen=True)
class Frontier:
    """The tables of the crawl (schemas.py), and what a step reports."""

    pending: DataFrame
    domain: DataFrame
    pages: DataFrame
    links: DataFrame
    seen: DataFrame
    outcome: DataFrame | None = None


def enqueue(state: Frontier, found: DataFrame, robots: DataFrame, now: Column) -> Frontier:
    """Adds page_links() rows to the queue: unseen, allowed by robots, within the budgets; and to the link table, with ids of what was queued."""
    urls = found.groupBy(F.col("target_url").alias("url")).agg(F.min(F.struct("source_page_id", "ord")).alias("place"))
    hosted = unseen(urls, state.seen).withColumn("host", host_of("url")).filter("host is not null")
    rules = robots_for(hosted.select("host").distinct(), robots, now)
    allowed = hosted.join(rules, "host").filter(robots_allowed("rules", path_of("url")))
    created = new_domains(allowed.groupBy("host").agg(F.first("rules").alias("rules")), state.domain, now)
    domain = state.domain.unionByName(created.select(*(F.col(f.name).cast(f.dataType) for f in state.domain.schema)))
    queued = within_budget(allowed.select("host", "url", "place"), domain)
    ids = domain.select(F.col("id").alias("domain_id"), F.col("domain_name").alias("host"))
    rows = queued.join(ids, "host").select(
        url_id(F.col("url")).alias("id"), "url", "domain_id", F.lit(None).cast("timestamp").alias("retry_after"), F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"), now.alias("created_at"), now.alias("updated_at"),
    )
    rows = cut(rows)
    counts = rows.groupBy(F.col("domain_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_more"))
    more = F.coalesce("_more", F.lit(0))
    domain = (
        domain.join(counts, "id", "left")
        .withColumn("next_available_at", F.when(more > 0, later_by_ms(now, F.col("crawl_delay_ms"))).otherwise(F.col("next_available_at")))
        .withColumn("pages_crawled", F.col("pages_crawled") + more)
        .select(*state.domain.columns)
    )
    linked = found.join(rows.select(F.col("url").alias("target_url"), F.col("id").alias("target_page_id")), "target_url", "left").select(
        F.xxhash64("source_page_id", "target_url").alias("id"), "source_page_id", "target_url", "target_page_id", "anchor_text", now.alias("discovered_at")
    )
    return replace(state, pending=state.pending.unionByName(rows), domain=domain, links=state.links.unionByName(linked))


def is_page(status: str = "status", kind: str = "content_type") -> Column:
    return (F.col(status) == 200) & F.lower(F.coalesce(kind, F.lit(""))).startswith("text/html")


def parsed(rows: DataFrame, now: Column) -> DataFrame:
    """Queue rows with ``_p``, their parsed html, as rows of page_metadata, and their raw ``links``."""
    return rows.select(
        "id", "url", "domain_id", "_p.title", "_p.text", "_p.description", "_p.canonical_url", F.lit(200).alias("http_status"), "_p.language", content_hash("_p.text").alias("content_hash"),
        now.alias("page_last_updated_at"), F.lit("PENDING").alias("index_status"), now.alias("created_at"), now.alias("updated_at"), F.col("_p.links").alias("links"),
    )


def crawl_step(state: Frontier, fetched: DataFrame, robots: DataFrame, now: Column, dns: DataFrame | None = None, per_domain: int = PER_DOMAIN) -> Frontier:
    """One turn of the crawl. fetched (url, status, content_type, html) stands for the network; a URL without a row has failed.

    outcome (id, url, status): ``done``, ``retry`` or ``disallowed``; done and disallowed rows leave the queue. What a turn fetches is read and
    parsed once and cut, as all tables are made from it; ``now`` should be one moment, not a clock.
    """
    picked = due_urls(state.pending, state.domain, now, per_domain).withColumn("host", host_of("url"))
    rules = robots_for(picked.select("host").distinct(), robots, now)
    answered = picked.join(rules, "host", "left").join(fetched.select("url", "status", "content_type", "html"), "url", "left")
    allowed = F.coalesce(robots_allowed("rules", path_of("url")), F.lit(True))
    verdict = F.when(~allowed, "disallowed").when(F.coalesce(is_page(), F.lit(False)), "done").otherwise("retry")
    read = F.col("verdict") == "done"
    parsed_once = answered.withColumn("verdict", verdict).withColumn("html", F.when(read, F.col("html"))).withColumn("_p", parse_html("html", "url"))
    turn = cut(parsed_once.select(*state.pending.columns, "verdict", "_p"))
    outcome = turn.select("id", "url", F.col("verdict").alias("status"))
    done = turn.filter("verdict = 'done'")
    pages = parsed(done, now)
    links = page_links(pages.select(F.col("id").alias("source_page_id"), F.explode("links").alias("l")).select("source_page_id", "l.ord", "l.href", "l.anchor"), dns)
    links = cut(links)
    failed = retry(turn.filter("verdict = 'retry'").select(*state.pending.columns), now)
    left = upsert(delete_keys(state.pending, turn.filter("verdict <> 'retry'"), "id"), failed, ["id"])
    seen = mark_seen(state.seen, turn)
    kept = upsert(state.pages, pages.select(*(F.col(f.name).cast(f.dataType) for f in state.pages.schema)), ["id"])
    after = enqueue(replace(state, pending=left, seen=seen, pages=kept), links, robots, now)
    return replace(after, seen=mark_seen(after.seen, after.pending), outcome=outcome)


def recrawl(pages: DataFrame, fetched: DataFrame, now: Column, cutoff: Column | None = None, limit: int = RECRAWL_BATCH) -> DataFrame:
    """Pages after another visit to those due: new content replaces title, text, description and hash and makes the page PENDING; the same
    content only moves updated_at; a failed visit changes nothing. Language, canonical URL and links stay."""
    cutoff = now - F.expr(f"INTERVAL {RECRAWL_DAYS} DAYS") if cutoff is None else cutoff
    chosen = recrawl_due(pages, cutoff, limit).select("id", "url").join(fetched.filter(is_page()).select("url", "html"), "url")
    p = chosen.withColumn("_p", parse_html("html", "url")).select("id", F.col("_p.title").alias("_title"), F.col("_p.text").alias("_text"), F.col("_p.description").alias("_description"), content_hash("_p.text").alias("_hash"))
    joined = pages.join(p, "id", "left")
    visited = F.col("_hash").isNotNull()
    new = visited & changed("_hash", "content_hash")
    for column, value in (("title", "_title"), ("text", "_text"), ("description", "_description"), ("page_last_updated_at", now), ("index_status", F.lit("PENDING"))):
        joined = joined.withColumn(column, F.when(new, F.col(value) if isinstance(value, str) else value).otherwise(F.col(column)))
    joined = joined.withColumn("http_status", F.when(new, F.lit(200)).otherwise(F.col("http_status"))).withColumn("updated_at", F.when(visited, now).otherwise(F.col("updated_at")))
    return joined.withColumn("content_hash", F.when(new, F.col("_hash")).otherwise(F.col("content_hash"))).select(*pages.columns)
