"""Connected components by alternating large-star and small-star steps.

Edges are narrow rows (two longs). Every step groups edges by a node, takes
the smallest neighbour and points the others to it; steps are written to the
shared folder, so no lineage grows and lost executors cost one step. A hub's
edges are pre-aggregated before the shuffle and joined with AQE's skew split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    # after the large star a node's smaller neighbours are the few roots near it, so they fit a window
    m = F.min("b").over(Window.partitionBy("a"))
    # the edge to m itself moves its upper end, every other edge its lower one
    return edges.select("a", "b", m.alias("m")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return loose.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of `edges` (a, b) but the roots themselves.

    Loops and repeated edges are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = materialize(oriented, "edges")
    while not _settled(now):
        after, new = materialize(_small_star(_large_star(now)), "edges")
        discard(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
