"""Connected components of a table of links, by alternating large-star and small-star.

Every step adds up by node before it shuffles and joins the minima back to the links, so no node's links meet in one task;
every step is a written table, so lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is the smallest of its component."""
    ends = edges.select("u", F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")).distinct())
    return ends.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b), the smallest node that it reaches. Self-links are ignored."""
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}_0")
    step = 0
    while not _stars(edges):
        # large-star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{tag}_{step}_m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{tag}_{step}_large")
        # small-star: u and its smaller neighbours are linked to the smallest of them
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_{step}_n")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.where("u <> v").distinct(), f"{tag}_{step}_small")
        scratch.drop(f"{tag}_{step}_m", f"{tag}_{step}_large", f"{tag}_{step}_n", f"{tag}_{step - 1}_small", *[f"{tag}_0"] * (step == 0))
        step += 1
    leaves = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return leaves.unionAll(roots.join(leaves, "u", "left_anti")).select(F.col("u").alias("node"), F.col("v").alias("component"))
