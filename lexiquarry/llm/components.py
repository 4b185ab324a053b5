"""Connected components of a link table by alternating large-star and small-star rounds.

Links never leave the cluster: a round is two aggregations and two joins, its result is written to
the shared folder, and only a count and a checksum reach the driver to see whether it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, until_stable


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) -> (node, root), one row per linked node, root being the least node of its component."""
    state = {"edges": scratch.keep(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), "sum": None}

    def step(i: int) -> bool:
        edges = state["edges"]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, f"{name}-{i + 1}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-{i + 1}")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{i + 1}-large")
        scratch.drop(f"{name}-{i}")
        state["edges"], before, state["sum"] = edges, state["sum"], tuple(found)
        return tuple(found) != before

    until_stable(step)
    edges = state["edges"]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
