"""Connected components by alternating large and small stars, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of links (a, b): label is the least node of its component.

    Each round hangs the neighbours of a node under the least of them; rows never outnumber the links.
    Every round is a written table, so a lost executor repeats one round at most. The least neighbours are
    written before they are joined, so that a node with very many neighbours is a skewed join, which Spark
    splits, and not an aggregate's single partition.
    """
    with Scratch() as scratch:
        edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
        before = None
        for _ in range(most_rounds):
            edges = _small(_large(edges, scratch), scratch)
            scratch.drop(*(t for t in scratch.tables if t is not edges))
            now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
            if now == before or not now["n"]:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        return written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct()), "labels")


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of u goes under the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return scratch.write(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every smaller neighbour of u, and u, go under the least of them."""
    least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return scratch.write(moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
