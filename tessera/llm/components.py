"""Connected components of a link table by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node that can be reached) of every node in ``links`` (a, b).

    Alternating star contraction: each round links the neighbours of a node to the least of them, first those above
    the node, then the rest. Rounds grow with the logarithm of the longest chain. Each round is a written table; no
    neighbourhood is gathered in one task. Null ends, loops and repeated links do no harm; no links give no rows.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(spark, edges)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # The larger neighbours of each node go to the least of its neighbourhood.
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Then the smaller neighbours of each node, and the node itself.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        edges = written(spark, small.filter("a <> b").distinct())
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return written(spark, edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one link, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()
