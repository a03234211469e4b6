"""Verify texts that met on keys: links whose components are those of all pairs of a Jaccard of `NEAR / OF` or more.

A run is what met on one key. Near copies meet on many keys, with other company on each, so runs that share texts are united as
long as what hangs together stays within the bound, and a text's shingles are sent once. Runs within a bound (`run_rows` texts, `run_items` shingles in all) are verified by one task
each, over lists of the texts that hold a shingle. A longer run never meets in one task:

1. In a few rounds every long run is held against one of its texts, the pivot. What is near the pivot is one class.
2. With all links so far, the texts of a run fall into classes. Texts of one class need no more comparisons with one another, so
   only those outside the run's largest class are left, and meet all others of the run.
3. That is done in blocks: the rest in `i` blocks, the run in `j`, a task for each (key, i, j), which again holds no more than
   the bound. Links are given as stars, so neither a family of near copies nor a run of strangers yields a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_if_small, map_batches, stored
from tidemark.llm.components import components

#: The least likeness as a fraction.
NEAR, OF = 4, 5
#: What a task compares at once: texts, and shingles in all.
RUN_ROWS, RUN_ITEMS = 2048, 4_000_000
#: Rounds in which long runs are held against a pivot, and the parts in which they meet it.
PIVOTS, SALTS = 3, 64


class Holders:
    """For each shingle of some sets the sets that hold it; tells how much any of these sets shares with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, self.sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
        self.codes, where = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(self.n), self.sizes)[np.argsort(where, kind="stable")]
        self.upto = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(self.codes)))))
        self.own = np.split(where, np.cumsum(self.sizes)[:-1])

    def near(self, i: int, step: int = 1024) -> np.ndarray:
        """Which sets are near set i."""
        both = np.zeros(self.n, dtype=np.int64)
        for k in range(0, len(self.own[i]), step):
            part = self.own[i][k : k + step]
            a, b = self.upto[part], self.upto[part + 1]
            at = np.arange(int((b - a).sum())) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)
            both += np.bincount(self.holders[at], minlength=self.n)
        return OF * both >= NEAR * (self.sizes[i] + self.sizes - both)


def link_run(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (member, first of its class) among texts that met, by exact Jaccard of all of them."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(names[1], names[0])] if OF * both >= NEAR * (len(sets[0]) + len(sets[1]) - both) else []
    index, left, out = Holders(sets), np.ones(n, dtype=bool), []
    for first in range(n):
        if not left[first]:
            continue
        left[first], reached = False, [first]
        while reached and left.any():
            found = np.flatnonzero(left & index.near(reached.pop()))
            left[found] = False
            reached += found.tolist()
            out += [(names[j], names[first]) for j in found.tolist()]
    return out


def link_blocks(names: list[int], sets: list[np.ndarray], classes: list[int], rest: list[bool]) -> list[tuple[int, int]]:
    """Links that join texts of the rest with texts of other classes: one for each two classes found near."""
    index, out = Holders(sets), []
    root = {c: c for c in classes}

    def top(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for i in np.flatnonzero(np.array(rest)).tolist():
        for j in np.flatnonzero(index.near(i)).tolist():
            a, b = top(classes[i]), top(classes[j])
            if a != b:
                root[a] = b
                out.append((names[i], names[j]))
    return out


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint64) for s in column]


def _by_key(verify) -> object:
    """mapInPandas function over rows sorted by their first columns, all but the last ones: verify each run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = list(zip(*(batch[c].tolist() for c in batch.columns if c in ("key", "i", "j")), strict=True))
            for k, row in zip(keys, batch.drop(columns=["key", "i", "j"], errors="ignore").itertuples(index=False), strict=True):
                if k != key:
                    out += verify(held) if len(held) > 1 else []
                    key, held = k, []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if len(held) > 1:
            yield pd.DataFrame(verify(held), columns=["a", "b"], dtype="int64")

    return run


def _whole(held: list) -> list[tuple[int, int]]:
    return link_run([r.fp for r in held], [np.frombuffer(r.shingles, dtype=np.uint64) for r in held])


def _blocks(held: list) -> list[tuple[int, int]]:
    """A text of the rest is in the block of the run as well where both name the same block; it counts once, as the rest."""
    rest = {r.fp for r in held if r.rest}
    held = [r for r in held if r.rest or r.fp not in rest]
    return link_blocks([r.fp for r in held], [np.frombuffer(r.shingles, dtype=np.uint64) for r in held], [r.class_fp for r in held], [r.rest for r in held])


def _pivoted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for fp, pivot, one, other in zip(batch["fp"].tolist(), batch["pivot"].tolist(), _sets(batch["shingles"]), _sets(batch["pivot_shingles"]), strict=True):
            both = len(np.intersect1d(one, other, assume_unique=True))
            if OF * both >= NEAR * (len(one) + len(other) - both):
                out.append((fp, pivot))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _long(members: DataFrame, sets: DataFrame, links: DataFrame, run_items: int, pivots: int) -> DataFrame:
    """links and those within runs beyond the bounds. members: (key, fp, n, items, total)."""
    rest = members
    for r in range(pivots):
        chosen = rest.groupBy(F.col("key").alias("of")).agg(F.min(F.struct(F.xxhash64("fp", F.lit(r)), "fp"))["fp"].alias("pivot"))
        salts = chosen.withColumnRenamed("of", "key").join(sets.select(F.col("fp").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        met = rest.select("key", "fp", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")).join(salts, ["key", "salt"]).filter("fp != pivot").join(sets, "fp")
        found = stored(map_batches(met.select("fp", "pivot", "shingles", "pivot_shingles"), _pivoted, "a long, b long"), "pivot-links")
        near = found.select(F.col("a").alias("fp")).union(found.select("b")).distinct()
        links, rest = links.union(found), stored(rest.join(chosen, (F.col("key") == F.col("of")) & (F.col("fp") == F.col("pivot")), "left_anti").join(near, "fp", "left_anti"), "past-pivots")
        if rest.limit(1).count() == 0:
            break
    roots = components(stored(links, "links-so-far"))
    classed = stored(members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "items", "total", F.coalesce("root", "fp").alias("class_fp")), "classed-members")
    largest = classed.groupBy("key", "class_fp").agg(F.count(F.lit(1)).alias("of")).groupBy("key").agg(F.max(F.struct("of", "class_fp"))["class_fp"].alias("largest"))
    marked = classed.join(largest, "key").withColumn("rest", F.col("class_fp") != F.col("largest"))
    left = marked.filter("rest").groupBy("key").agg(F.sum("items").alias("rest_total"))
    # Half the bound for either side, and half again, since a hash deals unevenly.
    parts = lambda total: F.ceil(F.col(total) * 4 / F.lit(run_items)).cast("int")
    placed = marked.join(left, "key").withColumn("is", parts("rest_total")).withColumn("js", parts("total"))
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    one = placed.filter("rest").select("key", at("is").alias("i"), F.explode(F.expr("sequence(0, js - 1)")).alias("j"), "fp", "class_fp", "rest")
    other = placed.select("key", F.explode(F.expr("sequence(0, is - 1)")).alias("i"), at("js").alias("j"), "fp", "class_fp", F.lit(False).alias("rest"))
    blocks = one.union(other).join(sets, "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "fp", "class_fp", "rest", "shingles")
    return links.union(map_batches(blocks, _by_key(_blocks), "a long, b long"))


def united(sized: DataFrame, run_rows: int, run_items: int) -> DataFrame:
    """(key, fp): runs that share texts are one where all that hangs together is within the bounds, and as they were elsewhere."""
    least = sized.groupBy("key").agg(F.min("fp").alias("least"))
    roots = components(sized.join(least, "key").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    whole = stored(sized.select("fp", "items").distinct().join(roots, F.col("fp") == F.col("node")).select("root", "fp", "items"), "united-runs")
    beyond = whole.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("total")).filter((F.col("n") > run_rows) | (F.col("total") > run_items)).select("root")
    beyond = stored(whole.join(beyond, "root", "left_semi").select("fp", "root"), "beyond-a-run")
    if beyond.limit(1).count() == 0:
        return whole.select(F.col("root").alias("key"), "fp")
    heads = broadcast_if_small(beyond.select("root").distinct(), 1_000_000)
    return whole.join(heads, "root", "left_anti").select(F.col("root").alias("key"), "fp").unionByName(sized.select("key", "fp").join(beyond.select("fp"), "fp", "left_semi"))


def links(members: DataFrame, sets: DataFrame, run_rows: int = RUN_ROWS, run_items: int = RUN_ITEMS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links among what met. members: (key, fp), and items (a set's n) if known; sets: (fp, n, shingles), n sorted 64-bit hashes as bytes.

    Members are stored, each row once. With items the sets are read once unless runs are long, so they may be laid out on the way.
    """
    sized = members if "items" in members.columns else stored(members.join(sets.select("fp", F.col("n").alias("items")), "fp"), "members-sized")
    runs = stored(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("total")), "runs-sized")
    bounds = (F.col("n") <= run_rows) & (F.col("total") <= run_items)
    long = runs.filter(~bounds)
    some = long.limit(1).count() > 0
    if some:
        sets = stored(sets, "sets-of-runs")
    whole = sized.join(broadcast_if_small(long.select("key"), 1_000_000), "key", "left_anti") if some else sized
    placed = broadcast_if_small(stored(united(whole, run_rows, run_items), "placed"), 1_000_000)
    together = sets.select("fp", "shingles").join(placed, "fp").repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "shingles")
    found = stored(map_batches(together, _by_key(_whole), "a long, b long"), "near-copies")
    if not some:
        return found
    return stored(_long(stored(sized.join(long.select("key", "n", "total"), "key"), "long-runs"), sets, found, run_items, pivots), "all-near-copies")


def classes(own: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """own's rows with class_fp and class_id, the least id that links reach. own: id, fp; distinct: fp, least; found: (a, b) of fps."""
    roots = components(found)
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    names = classed.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("class_id"))
    by_fp = classed.join(names, F.col("class") == F.col("c")).select(F.col("fp").alias("f"), F.col("class").alias("class_fp"), "class_id")
    return own.join(by_fp, F.col("fp") == F.col("f")).drop("f")
