"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, small_plans, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of the component.

    Each round links every node's neighbours to the smallest of them, once for the larger and
    once for the smaller ones, until nothing changes; the rounds grow with the logarithm of the
    number of nodes. Minima are aggregated with map-side combine and joined back, so a node with
    very many edges is no single group; each round ends in reliable storage.
    """
    with small_plans(edges.sparkSession):
        now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = None
        while True:
            both = _both(now)
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # Small star: large-star edges point from the larger to the smaller node already.
            lower = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(lower, "u")
            last = now
            now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
            new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
            discard(last)
            if mark == new:
                break
            mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
