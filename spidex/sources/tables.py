"""Readers of tables, and the tables that stand for the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spidex.operators.frontier import PAGES_PER_DOMAIN, url_id

SEED_DELAY_MS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table; with columns, only those are read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def rows_by_key(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys``. Spark broadcasts the keys where it knows them to be small."""
    return rows.join(keys.select(on).distinct(), on, "left_semi")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as answers of the network: (url, status, content_type, html)."""
    return pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html")


def seed_rows(spark: SparkSession, seeds: dict[str, list[str]], now: Column) -> tuple[DataFrame, DataFrame]:
    """(domain rows, queue rows) of {domain: [url, ...]}."""
    given = spark.createDataFrame([(d, u) for d, u in seeds.items()], "domain_name string, urls array<string>")
    domains = given.select(
        F.xxhash64("domain_name").alias("id"), "domain_name", now.alias("next_available_at"), F.lit(SEED_DELAY_MS).alias("crawl_delay_ms"), F.lit(PAGES_PER_DOMAIN).alias("max_pages"),
        F.lit(0).alias("pages_crawled"), now.alias("created_at"), now.alias("updated_at"),
    )
    queue = given.select(F.xxhash64("domain_name").alias("domain_id"), F.explode("urls").alias("url")).select(
        url_id(F.col("url")).alias("id"), "url", "domain_id", F.lit(None).cast("timestamp").alias("retry_after"), F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"), now.alias("created_at"), now.alias("updated_at"),
    )
    return domains, queue.dropDuplicates(["url"])
