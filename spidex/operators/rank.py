"""PageRank over an edge table, and the tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spidex.operators.lineage import cut

DAMPING, MOST_ROUNDS, TOLERANCE = 0.85, 50, 1e-6


def out_degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (src, dst) without null targets, and (src, degree)."""
    distinct = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    return distinct, distinct.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, max_iter: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, score) of vertices (id) and of targets outside them.

    Each round a vertex has 1 - damping plus what sources give it, a source damping * score / degree to each target; nothing
    comes from pages without links, and targets outside the vertices have only what they are given. Rounds end when the
    vertices' scores move less than ``tolerance`` in all. Edges are weighed and dealt by source once.
    """
    v = cut(vertices.select("id").filter("id is not null").distinct())
    n = v.count()
    if not n:
        return v.sparkSession.createDataFrame([], "id string, score double").select(F.col("id").cast(v.schema["id"].dataType), "score")
    distinct, degree = out_degrees(edges)
    weighed = cut(distinct.join(degree, "src").join(v.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("w")))
    scores = cut(v.withColumn("score", F.lit(1.0 / n)).withColumn("inside", F.lit(True)))
    for _ in range(max_iter):
        given = weighed.join(scores.filter("inside").select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("given"))
        joined = scores.filter("inside").select("id", F.col("score").alias("old"), "inside").join(given, "id", "full_outer")
        new = joined.select("id", (F.when(F.col("inside"), 1 - damping).otherwise(0.0) + F.coalesce("given", F.lit(0.0))).alias("score"), F.coalesce("inside", F.lit(False)).alias("inside"), "old")
        scores = cut(new)
        if tolerance and (scores.filter("inside").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return scores.select("id", "score")


def discovered_edges(links: DataFrame) -> DataFrame:
    """(src, dst) of page_link rows whose target was queued by the page that held the link."""
    return links.filter("target_page_id is not null").select(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst"))


def edges_by_url(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst) of all page_link rows whose target URL is a known page (id, url)."""
    return links.join(pages.select(F.col("id").alias("dst"), F.col("url").alias("target_url")), "target_url").select(F.col("source_page_id").alias("src"), "dst")


def empty_ranks(spark: SparkSession) -> DataFrame:
    from spidex.schemas import PAGE_RANK

    return spark.createDataFrame([], PAGE_RANK)
