"""Connected components of an edge table by alternating large and small stars.

Each round joins edges with one row a node. A hub with a large share of the edges is dealt over many tasks
(join_spread), and nothing of a node is gathered in one row. Each round's edges are written to the shared folder,
so lineage stays short and a lost executor costs one round at most; the round before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_spread, written


def _is_done(edges: DataFrame) -> bool:
    """Whether each edge goes from a node to its root: no node has two edges up, none has edges both ways."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.union(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _with_least(ends: DataFrame, total: int) -> DataFrame:
    """ends (a, b) with m, the smallest of a and all its b."""
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_spread(ends, least.select("a", "m"), "a", hot_keys(least, "a", "n", total), "b")


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbourhood."""
    moved = _with_least(edges.union(edges.select("b", "a")), 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, total)
    pairs = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node that an edge has.

    edges: two columns a, b of one orderable type, without nulls.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_done(now):
        before, large = now, written(_large(now, now.count()), "edges")
        now = written(_small(large, large.count()), "edges")
        discard(before, large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
