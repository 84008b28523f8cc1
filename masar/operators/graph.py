"""Operators over travel-time edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.operators.lineage import cut


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """(dst, sources): the edges into each node."""
    return edges.groupBy("dst").agg(F.collect_list(F.struct("src", "sec")).alias("sources"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its mirror; duplicates stay."""
    return edges.select("src", "dst", "sec").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sec"))


def bounded_reverse(edges: DataFrame, target: int, max_sec: float, max_hops: int | None = None) -> DataFrame:
    """(node, sec): the least travel time of each node to the target, where it is within the bound.

    Frontiers relax in joins on the edges' ends; only nodes whose time got better go on. Parallel edges count by their least time.
    Each round is checkpointed, as its lineage would grow with the rounds.
    """
    spark = edges.sparkSession
    best_edges = edges.groupBy("src", "dst").agg(F.min("sec").alias("sec")).cache()
    best = spark.createDataFrame([(target, 0.0)], "node long, sec double")
    frontier, hops = best, 0
    while max_hops is None or hops < max_hops:
        reached = frontier.join(best_edges, F.col("dst") == F.col("node")).groupBy("src").agg(F.min(frontier.sec + best_edges.sec).alias("t")).filter(F.col("t") <= max_sec)
        better = reached.join(best.select(F.col("node").alias("k"), F.col("sec").alias("old")), F.col("src") == F.col("k"), "left").filter(F.col("old").isNull() | (F.col("t") < F.col("old"))).select(F.col("src").alias("node"), F.col("t").alias("sec"))
        better = cut(better)
        if better.isEmpty():
            break
        best = cut(best.union(better).groupBy("node").agg(F.min("sec").alias("sec")))
        frontier, hops = better, hops + 1
    best_edges.unpersist()
    return best


def upstream(edges: DataFrame, target: int, want_sec: float, tolerance: float, max_hops: int | None = None) -> DataFrame:
    """(node, sec, delta): nodes whose time to the target is within the tolerance of the wanted one, not the target itself."""
    near = bounded_reverse(edges, target, want_sec * (1 + tolerance) + 60, max_hops)
    delta = F.abs(F.col("sec") - want_sec)
    return near.filter((F.col("node") != target) & (delta <= want_sec * tolerance)).withColumn("delta", delta)
