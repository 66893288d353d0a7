"""Connected components of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

MOST_ROUNDS = 100


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every linked id but the roots themselves; a root is the smallest id reachable.

    Each round points the neighbours of an id at the smallest of them, until no target has a smaller neighbour itself.
    Only sums per id and equi-joins on written tables are used, so the neighbours of a hub are never in one place, and
    Spark can split its side of a join.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        pointed = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges = materialize(pointed.distinct(), "large-star")
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
    raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
