"""Dependency graphs as tables of edges: an order in which each node follows all that it needs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: So many edges may be ordered by one task.
MOST_EDGES = 200_000


def _peeler(depth: int):
    """mapInPandas function over all edges left (above, below): (node, depth) of each node with needs; null on or above a cycle.

    Every node without needs here has the given depth. Made here, so that it travels with its code.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waits, above = defaultdict(int), defaultdict(list)
        for batch in batches:
            for a, b in zip(batch["above"].tolist(), batch["below"].tolist(), strict=True):
                waits[a] += 1
                above[b].append(a)
        ready, found = [b for b in above if b not in waits], {}
        level = depth
        while ready:
            level, after = level + 1, []
            for b in ready:
                for a in above[b]:
                    waits[a] -= 1
                    if not waits[a]:
                        found[a] = level
                        after.append(a)
            ready = after
        if waits:
            yield pd.DataFrame({"node": list(waits), "depth": pd.array([found.get(n) for n in waits], dtype="Int32")})

    return run


def ancestors_first(nodes: DataFrame, edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, depth): depth is the longest chain of needs below a node, null where a cycle forbids any order.

    nodes: node; edges: node, needs. Edges from or to what isn't a node don't count. Nodes are peeled by level: those whose needs are
    all placed get a depth and leave with the edges to them; what is left when none can leave is on a cycle or above one. A
    level is two joins and a stored table of the edges left, in as many tasks as these need. As soon as at most
    `most_edges` are left, one task orders them in linear time, so long chains at the end cost no rounds.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    known = stored(nodes.select("node").filter("node IS NOT NULL").distinct(), "graph-nodes")
    ends = edges.select(F.col("node").alias("above"), F.col("needs").alias("below")).distinct()
    left = ends.join(known.select(F.col("node").alias("above")), "above", "left_semi").join(known.select(F.col("node").alias("below")), "below", "left_semi")
    left = stored(left.select("above", "below"), "graph-edges")
    frontier = known.join(left.select(F.col("above").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("depth"))
    placed, depth = [stored(frontier, "graph-level")], 0
    while left.limit(most_edges + 1).count() > most_edges:
        after = stored(left.join(placed[-1].select(F.col("node").alias("below")), "below", "left_anti").select("above", "below"), "graph-edges")
        ready = left.select("above").distinct().join(after.select("above").distinct(), "above", "left_anti")
        depth += 1
        placed.append(stored(ready.select(F.col("above").alias("node"), F.lit(depth).alias("depth")), "graph-level"))
        left = after
        if placed[-1].limit(1).count() == 0:
            break
    if left.limit(most_edges + 1).count() > most_edges:
        rest = left.select(F.col("above").alias("node")).distinct().withColumn("depth", F.lit(None).cast("int"))
    else:
        rest = left.coalesce(1).mapInPandas(_peeler(depth), f"node {kind}, depth int")
    found = placed[0]
    for level in placed[1:]:
        found = found.union(level)
    return found.union(rest)
