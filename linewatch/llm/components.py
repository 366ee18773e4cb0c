"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, stored


def _least(edges: DataFrame) -> DataFrame:
    """Edges u, v with the least number among u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _least(down)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of ``links`` (columns a, b, 64-bit); nodes without links are left out.

    Each round is written to the scratch folder and read back; the round before is deleted. Rounds grow with the logarithm
    of the longest path. A node's neighbours are only aggregated and joined, never gathered.
    """
    spark = links.sparkSession
    edges, path = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, old = now, path
        edges, path = stored(_small_star(_large_star(edges)).where("u != v").distinct(), "components")
        drop_stored(spark, old)
