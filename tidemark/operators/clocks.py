"""Clocks of many nodes: the stamps of their events, and their state after what they received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators.numbering import NOWHERE, group_keys, lot_of


def now_stamps(events: DataFrame, node: str, seq: str, physical: str, counters: int = clock.MOST_COUNTER + 1) -> DataFrame:
    """The stamp of each local event of a fresh clock per node, read in the order of seq (a number).

    Wall and counter as one number, wall * counters + counter, which each event raises by one or to its physical time: what
    the clock's step-by-step rule gives, its carry included. So the n-th event of a node has n plus the running maximum of
    (physical * counters - n), and a node's events spread over lots of seq, also while its clock stands still. A lot counts from one;
    how many events were before it, and their greatest difference, follow from one row a lot. An event without a seq comes first.
    """
    by = ["_g0", "_lot"]
    laid = events.withColumns({**group_keys([node]), "_lot": F.coalesce(lot_of(F.col(seq)), F.lit(NOWHERE))})
    inside = Window.partitionBy(*by).orderBy(seq, physical).rowsBetween(Window.unboundedPreceding, 0)
    numbered = laid.withColumn("_n", F.row_number().over(inside).cast("long")).withColumn("_a", F.col(physical).cast("long") * counters - F.col("_n"))
    lots = numbered.groupBy(*by).agg(F.max("_n").alias("_many"), F.max("_a").alias("_most"))
    before = Window.partitionBy("_g0").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = lots.withColumn("_start", F.coalesce(F.sum("_many").over(before), F.lit(0)))
    starts = starts.select(*by, "_start", F.max(F.col("_most") - F.col("_start")).over(before).alias("_before"))
    own = numbered.withColumn("_m", F.max("_a").over(inside)).join(starts, by)
    ticks = own.withColumn("_t", F.col("_n") + F.col("_start") + F.greatest("_before", F.col("_m") - F.col("_start"))).drop(*by, "_a", "_m", "_start", "_before")
    split = ticks.withColumn("wall", F.floor(F.expr(f"_t div {counters}"))).withColumn("counter", F.col("_t") % counters).drop("_t", "_n")
    return split.withColumn("stamp", clock.encode(F.col("wall"), F.col("counter"), F.col(node).cast("string")))


def update_clocks(events: DataFrame, node: str, seq: str, physical: str, remote: str, most_drift: int | None = None) -> DataFrame:
    """(node, wall, counter, refused) after all of a node's events; remote: column of received stamps, null for local events.

    A lot of steps acts on the clock before it in one of three ways. A wall above all of the lot's stays and counts its n
    steps; one below is replaced by the lot's greatest wall and a counter that doesn't depend on what was before; an equal
    one takes the larger of counting on and of what the lot makes of a counter of 0. So lots are folded apart, and a
    node's lots, not its steps, meet in one row.
    """
    part = clock.parse(F.col(remote))
    step = F.struct(F.col(seq).alias("seq"), F.col(physical).cast("long").alias("physical"), part["wall"].alias("remote_wall"), part["counter"].cast("long").alias("remote_counter"))
    lots = events.groupBy(node, lot_of(F.col(seq)).alias("lot")).agg(F.array_sort(F.collect_list(step)).alias("s"))
    first = lots.select(node, "lot", "s", clock.receive_fold(F.col("s"), most_drift).alias("f"))
    equal = clock.receive_fold(F.col("s"), most_drift, F.col("f.wall"))["counter"]
    sums = first.select(node, F.struct("lot", F.col("f.wall").alias("wall"), F.col("f.counter").alias("fresh"), equal.alias("equal"), (F.size("s") - F.col("f.refused")).alias("n"), F.col("f.refused").alias("refused")).alias("l"))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("wall", "counter", "refused")))

    def join(c: Column, x: Column) -> Column:
        on = c["counter"] + x["n"]
        counter = F.when(c["wall"] > x["wall"], on).when(c["wall"] == x["wall"], F.greatest(on, x["equal"])).otherwise(x["fresh"])
        over = clock.MOST_COUNTER + 1
        wall = F.greatest(c["wall"], x["wall"]) + F.floor(counter / over)
        return F.struct(wall.cast("long").alias("wall"), (counter % over).cast("long").alias("counter"), (c["refused"] + x["refused"]).alias("refused"))

    folded = sums.groupBy(node).agg(F.aggregate(F.array_sort(F.collect_list("l")), zero, join).alias("c"))
    return folded.select(node, "c.wall", "c.counter", "c.refused")
