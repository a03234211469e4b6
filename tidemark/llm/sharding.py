"""Cut ordered groups of rows into shards so that the largest shard is as small as can be, with built-in functions only.

Groups (rows with equal keys) are atomic and ordered by the digest of their key; a shard is a run of groups.
A binary search over the shard capacity tests each candidate greedily: fill shards in order, start the next
where the capacity would be exceeded. The cuts are the most even ones that the smallest capacity allows. The driver never sees the groups: it sees their sizes summed by the
first digits of the digest, and then, for the few cells in which a cut can fall, summed by more digits, until
each such cell is one group. The number of cells it holds is bounded by the digits of a level.

Slots number a shard's rows from 0 without gaps: rows are numbered in small lots, and a lot starts where the
counts of the lots before it end, so no task holds a shard.

Defined cases: null texts are one group (and the empty text another); rows that repeat stay together; null ids
are kept; fewer groups than shards leave shards empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored

MOST_DIGITS = 32
#: Sorts after every hexadecimal digest.
PAST_ALL = "~"
#: Rows numbered together, about; a shard's lots are as many as needed, up to LOTS.
LOT_ROWS, LOTS = 20_000, 65_536


def greedy_cuts(sizes: Sequence[int], capacity: int, shards: int) -> list[int] | None:
    """Indexes at which a new shard starts when shards are filled up to the capacity; None if they don't suffice."""
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if filled + size > capacity:
            cuts.append(i)
            filled = 0
            if len(cuts) >= shards:
                return None
        filled += size
    return cuts


def least_capacity(sizes: Sequence[int], shards: int) -> int:
    """The smallest capacity that is feasible, by binary search."""
    low, high = max([-(-sum(sizes) // shards), *sizes], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(sizes: Sequence[int], capacity: int, shards: int) -> list[int]:
    """Where shards 2 to `shards` start, within a feasible capacity and as evenly as that allows.

    Filling to the brim would starve the last shards where one group is larger than the mean. So each shard ends at
    the boundary nearest to its share of what is left, between the first one from which the rest still fits (by
    filling from the end) and the last one that fits the shard.
    """
    ends = [0, *accumulate(sizes)]
    n, fits = len(sizes), [len(sizes)]
    for _ in range(shards - 1):
        fits.append(bisect_left(ends, ends[fits[-1]] - capacity))
    cuts, start = [], 0
    for rest in range(shards - 1, 0, -1):
        first, last = max(start, fits[rest]), bisect_right(ends, ends[start] + capacity) - 1
        share = ends[start] + (ends[n] - ends[start]) / (rest + 1)
        at = bisect_left(ends, share)
        if at > start and at <= n and share - ends[at - 1] < ends[at] - share:
            at -= 1
        start = min(max(at, first), last)
        cuts.append(start)
    return cuts


def _reach(cells: list[tuple[str, int, int, int]], capacity: int, divisible: bool) -> list[int]:
    """Sizes before each cut of the greedy test, with cells of several groups atomic or divisible at will."""
    cuts, base, done = [], 0, 0
    for _, size, count, _ in cells:
        while done + size - base > capacity and done + size > base:
            base = base + capacity if divisible and count > 1 else done
            cuts.append(base)
            if base == done and size > capacity:
                base = done + size  # a group above the capacity; the bounds exclude it
        done += size
    return cuts


def minimax_cuts(groups: DataFrame, shards: int, first_digits: int = 4, more_digits: int = 2) -> list[str]:
    """First keys of the second and later shards. groups: key (hexadecimal digest), size (long), one row a group.

    The optimum lies between low (mean and largest group) and high (feasible with whole cells). For any capacity
    between them, each cut of the greedy test lies between where it falls for low with whole cells and for high with
    divisible ones; the cells between are refined. Once all of them are single groups, the search is exact.
    """

    def summed(df: DataFrame, n: int) -> list[tuple[str, int, int, int]]:
        rows = df.groupBy(F.substring("key", 1, n).alias("cell")).agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect()
        return [(r[0], r[1], r[2], r[3]) for r in rows]

    cells = sorted(summed(groups, first_digits))
    while True:
        low = max([-(-sum(c[1] for c in cells) // shards), *(c[3] for c in cells)], default=0)
        several = [i for i, c in enumerate(cells) if c[2] > 1 and len(c[0]) < MOST_DIGITS]
        doubt = {i for i in several if cells[i][1] > low}
        if not doubt:
            high = least_capacity([c[1] for c in cells], shards)
            if high == low:
                break
            early, late, total = _reach(cells, low, False), _reach(cells, high, True), sum(c[1] for c in cells)
            spans = [(a, late[j] if j < len(late) else total) for j, a in enumerate(early[: shards - 1])]
            ends = list(accumulate(c[1] for c in cells))
            doubt = {i for a, b in spans for i in range(bisect_right(ends, a), min(len(ends), bisect_left(ends, b) + 1))} & {*several}
        if not doubt:
            break
        finer = []
        for n in sorted({len(cells[i][0]) for i in doubt}):
            names = [cells[i][0] for i in doubt if len(cells[i][0]) == n]
            finer += summed(groups.filter(F.substring("key", 1, n).isin(names)), min(MOST_DIGITS, n + more_digits))
        cells = sorted([c for i, c in enumerate(cells) if i not in doubt] + finer)
    return [cells[i][0] if i < len(cells) else PAST_ALL for i in even_cuts([c[1] for c in cells], high, shards)]


def digest(key: Column) -> Column:
    """Groups of equal keys; null apart from every text."""
    return F.when(key.isNull(), F.lit("0" * 32)).otherwise(F.md5(key))


def shard(rows: DataFrame, key: Column, size: Column, shards: int = 24, keep: dict[str, Column] | None = None) -> DataFrame:
    """(keep..., size, shard, slot) of each row; key and size are expressions over rows.

    The rows' digests and sizes are stored once, slim; everything that follows reads that table.
    Shards follow from the rows alone. Slots follow the order in which tasks read them, so a rerun over other file splits may
    number the rows of a shard in another order; a lost task's rerun within one job reads the stored numbers.
    """
    keep = keep or {}
    slim = stored(rows.select(*(v.alias(k) for k, v in keep.items()), digest(key).alias("_key"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("_at")), "shard-rows")
    groups = stored(slim.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size")), "shard-groups")
    cuts = minimax_cuts(groups, shards)
    number = sum((F.when(F.col("_key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    lots = max(1, min(LOTS, -(-slim.count() // (LOT_ROWS * shards))))
    placed = slim.select(*keep, "size", number.alias("shard"), F.pmod(F.xxhash64("_at"), F.lit(lots)).cast("int").alias("_lot"), "_at")
    counts = placed.groupBy("shard", "_lot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_s"), F.col("_lot").alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_lot").orderBy("_at"))
    out = placed.withColumn("_rank", rank).join(starts, (F.col("shard") == F.col("_s")) & (F.col("_lot") == F.col("_l")))
    return out.select(*keep, "size", "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, shards: int = 24) -> None:
    """One folder a shard, its rows in slot order."""
    sharded.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
