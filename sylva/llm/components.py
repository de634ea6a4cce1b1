"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is two group-by minima and joins and ends in a table in the shared folder, so lineage stays short
and nothing but two numbers a round reaches the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v), whose root is the smallest node of its component."""
    now = write_table(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    was = None
    for _ in range(limit):
        now = write_table(_star(_star(now, True), False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = tuple(state)
    raise RuntimeError("components did not settle")
