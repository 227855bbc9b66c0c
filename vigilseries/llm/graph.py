"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    moved = both.where("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the component's smallest.

    Each round writes its edges; the end is reached when a round changes none, which takes about
    the logarithm of the longest path. Hubs are aggregated before they move.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "graph-edges")
    known = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == known:
            break
        known = tuple(mark)
        now = materialise(_small(_large(now)), "graph-stars")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
