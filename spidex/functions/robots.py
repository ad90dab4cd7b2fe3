"""Robots rules: parsing, the longest match, and the delay between fetches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spidex.schemas import ROBOTS_RULES

AGENT = "SpidexBot"
LEAST_DELAY_MS, LIFETIME_HOURS = 500, 24


def parse(body: str | None, agent: str = AGENT) -> dict:
    """Rules of the group that applies as lines go by: ours, or the wildcard's as long as ours hasn't been seen."""
    rules: dict = {"disallow": [], "allow": [], "crawl_delay_s": None}
    inside = ours_seen = False
    for line in (body or "").split("\n"):
        field, colon, value = line.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            ours = value.lower() == agent.lower()
            inside = ours or (value == "*" and not ours_seen)
            ours_seen |= ours
        elif inside and field in ("disallow", "allow") and value:
            rules[field].append(value)
        elif inside and field == "crawl-delay":
            try:
                rules["crawl_delay_s"] = int(float(value))
            except (ValueError, OverflowError):
                pass
    return rules


def parse_robots(body: Column | str, agent: str = AGENT) -> Column:
    """struct<disallow, allow, crawl_delay_s>; a null or blank body allows all. Bodies are one a host, in Arrow batches."""

    @F.pandas_udf(ROBOTS_RULES)
    def rules(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(b, agent) for b in bodies], columns=["disallow", "allow", "crawl_delay_s"]).astype({"crawl_delay_s": "Int32"})

    return rules(F.col(body) if isinstance(body, str) else body)


def _longest(patterns: Column, path: Column) -> Column:
    """The length of the longest pattern, its own trailing * included, whose rest the path starts with; -1: none."""
    fits = F.filter(patterns, lambda p: (p != "") & path.startswith(F.when(p.endswith("*"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)))
    return F.coalesce(F.array_max(F.transform(fits, lambda p: F.length(p))), F.lit(-1))


def robots_allowed(rules: Column | str, path: Column | str) -> Column:
    """No rule against it, or one for it that is as long as the longest against; null rules allow all."""
    r, p = (F.col(x) if isinstance(x, str) else x for x in (rules, path))
    against, in_favour = _longest(r["disallow"], p), _longest(r["allow"], p)
    return r.isNull() | (against == -1) | (in_favour >= against)


def crawl_delay_ms(rules: Column | str) -> Column:
    r = F.col(rules) if isinstance(rules, str) else rules
    return F.greatest(F.lit(LEAST_DELAY_MS), F.coalesce(r["crawl_delay_s"], F.lit(0)) * 1000).cast("int")


def robots_for(hosts: DataFrame, robots: DataFrame, now: Column, agent: str = AGENT) -> DataFrame:
    """hosts (host) with ``rules`` from robots (host, status, body, fetched_at), and ``stale`` where those are older than a day or missing.

    A status of 400 or more, or no answer, allows all.
    """
    body = F.when((F.col("status") < 400) & F.col("body").isNotNull(), F.col("body")).otherwise(F.lit(""))
    latest = robots.groupBy("host").agg(F.max_by(F.struct("status", "body", "fetched_at"), "fetched_at").alias("r")).select("host", "r.*")
    parsed = latest.select("host", parse_robots(body, agent).alias("rules"), "fetched_at")
    stale = F.col("fetched_at").isNull() | (F.col("fetched_at") + F.expr(f"INTERVAL {LIFETIME_HOURS} HOURS") < now)
    return hosts.join(parsed, "host", "left").withColumn("stale", stale).drop("fetched_at")


def stale_hosts(hosts: DataFrame, robots: DataFrame, now: Column) -> DataFrame:
    """(host) of those whose file is to be fetched (again) before their rules are used: it is missing or older than a day."""
    fetched = robots.groupBy("host").agg(F.max("fetched_at").alias("fetched_at"))
    fresh = fetched.filter(F.col("fetched_at") + F.expr(f"INTERVAL {LIFETIME_HOURS} HOURS") >= now)
    return hosts.select("host").filter("host is not null").distinct().join(fresh, "host", "left_anti")
