"""Connected components of an edge table by alternating star contractions, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import shared_checkpoint


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of each node on the smallest node next to it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs the smaller neighbours of each node, and the node, on the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (the smallest node that can be reached) for each node that has an edge.

    Edges are undirected; loops, repeats and nulls are ignored. Ids can be of any type that can be
    ordered. Each round is checkpointed in the shared folder; rounds grow with the logarithm of the
    longest path. A node with very many neighbours is one key of a join whose other side has one row
    for each key, which adaptive execution splits, and of sums that are combined before they are dealt.
    """
    a, b = F.col(src), F.col(dst)
    now = shared_checkpoint(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    before, signature = None, _signature(now)
    while signature != before and signature[0]:
        now = shared_checkpoint(_small_star(_large_star(now)))
        before, signature = signature, _signature(now)
    leaves = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return leaves.union(roots).groupBy("node").agg(F.min("component").alias("component"))
