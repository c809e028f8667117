"""Connected components of a link table by alternating star contraction.

Each round rewires every node to the least node of its neighbourhood, first
for its larger neighbours, then for itself and its smaller ones, until nothing
changes; rounds grow with the logarithm of the components' diameter. Tables
are cut off from their lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the least node reachable."""
    links = links.filter("a <> b")
    pairs = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        small = _least(large)
        pairs = stored(small.select(F.col("v").alias("u"), F.col("least").alias("v"))
                       .union(small.select("u", F.col("least").alias("v"))).filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
