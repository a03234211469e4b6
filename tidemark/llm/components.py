"""Connected components of a distributed table of links, by alternating star rewrites.

A large-star step links every larger neighbour of a node to the least node of its neighbourhood, a small-star
step does so for the smaller ones. Components stay as they are, links become stars around the least node within
a number of rounds that grows with the logarithm of the longest chain. Each round is stored in the shared
folder, so neither the lineage nor the driver grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b) rewritten around the least node of each neighbourhood."""
    if large:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = around.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node it can reach. links: two columns of one type."""
    x, y = links.columns
    current = stored(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a != b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        sums = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == sums or not sums[0]:
            break
        mark = sums
        current = stored(_star(_star(current, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b")).distinct()
