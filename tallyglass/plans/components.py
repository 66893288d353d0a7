"""Connected components of links by joins and sums only (alternating stars, Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROUNDS = 64


def star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest of them and itself: its larger neighbours, or its smaller ones."""
    if larger_only:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    seen = edges.join(least, "u")
    if larger_only:
        moved = seen.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        moved = seen.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return moved.distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) of every linked id but the roots, each the smallest id that links lead to. Needs a checkpoint folder.

    A hub's neighbours are never gathered: a round is two sums by node and two equi-joins, whose skew Spark can split. The
    edges of a round are checkpointed, so lineage stays short.
    """
    ends = links.select(F.col(a).alias("p"), F.col(b).alias("q")).filter("p <> q")
    edges = ends.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct().checkpoint()
    for _ in range(MOST_ROUNDS):
        roots = edges.select(F.col("v").alias("u"))
        if edges.join(roots, "u", "left_semi").isEmpty():  # no target points on: all are stars
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = star(star(edges, True), False).checkpoint()
    raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
