"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps take the least neighbour of each node by a pre-aggregated minimum that is joined back, so a node with very
many neighbours is split like any skewed join key and no neighbour list is ever collected. Edges are written to the
shared folder after each round. The number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _sum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (u, v long) -> (node, component): component is the least node of node's component. Nodes without an edge are left out."""
    e = scratch.put(f"{name}0", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, k = _sum(e), 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.put(f"{name}large{k}", large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = scratch.put(f"{name}{k + 1}", small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        scratch.drop(f"{name}large{k}", f"{name}{k}")
        now, k = _sum(e), k + 1
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
