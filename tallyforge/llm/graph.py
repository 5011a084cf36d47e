"""Connected components of an edge table by alternating large-star and small-star steps (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component), component the smallest node reachable.

    Each round is written to the shared folder. Rounds end when the edge set stays the same; their number grows with
    the logarithm of the longest path. Nodes without edges are not returned; self-loops and repeated edges are harmless.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(current)
    while seen[0]:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = materialize(small, "edges")
        now = _state(current)
        if now == seen:
            break
        seen = now
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(current.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(row)
