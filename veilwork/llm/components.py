"""Connected components by alternating large-star and small-star steps.

Links stay distributed: each step is one aggregation and one join, and the
number of steps grows with the logarithm of the longest chain.  Neither links
nor labels reach the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (hi, lo) with hi > lo, distinct."""
    if large:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            low.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def connected_components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable.  Nodes
    without a link between different nodes are left out; null ends are ignored."""
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = scratch.save(edges)
    before = _state(edges)
    while before[0]:
        half = scratch.save(_star(edges, True))
        after_edges = scratch.save(_star(half, False))
        scratch.drop(edges, half)
        edges = after_edges
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
