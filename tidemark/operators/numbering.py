"""Gapless numbers and running folds for the rows of large groups, without a group in one task.

A group's rows are dealt into lots of the order's range. Folds run within a lot by a window, and a lot starts with the fold of those
before it; only the lots' own folds, one row each, meet by group. These come from partial aggregates over the columns they
need, so the rows are laid out once. A row without a group belongs to the group of all such rows, one without a place in the order comes
first: none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a lot in a range of versions or positions, which are dense.
LOT = 65_536
#: The lot of rows without a place.
NOWHERE = -(1 << 62)


def lot_of(number: Column) -> Column:
    return F.floor(number / LOT)


def group_keys(groups: list[str]) -> dict[str, Column]:
    """Columns that stand for the groups, never null, so that windows and joins by them share one partitioning."""
    return {f"_g{i}": F.when(F.col(g).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(g).cast("string"))) for i, g in enumerate(groups)}


def running(rows: DataFrame, groups: list[str], order: list, lot: Column, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """rows with sums and maxima by name, over the rows of the group up to and with each by `order`, all in one pass.

    order is unique within a group, and lot must not decrease along it.
    """
    folds = {n: (F.sum, v, lambda start, own: F.coalesce(start, F.lit(0)) + own) for n, v in (sums or {}).items()}
    folds |= {n: (F.max, v, F.greatest) for n, v in (maxes or {}).items()}
    keys = group_keys(groups)
    by = [*keys, "_lot"]
    laid = rows.withColumns({**keys, "_lot": F.coalesce(lot.cast("long"), F.lit(NOWHERE)), **{f"_v_{n}": v for n, (_, v, _) in folds.items()}}).repartition(*by)
    every = F.max(F.xxhash64(*laid.columns)).alias("_every")
    totals = laid.groupBy(*by).agg(*(fold(f"_v_{n}").alias(f"_t_{n}") for n, (fold, _, _) in folds.items()), every).filter("_every IS NOT NULL")
    before = Window.partitionBy(*keys).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, *(fold(f"_t_{n}").over(before).alias(f"_s_{n}") for n, (fold, _, _) in folds.items()))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = laid.withColumns({f"_i_{n}": fold(f"_v_{n}").over(inside) for n, (fold, _, _) in folds.items()})
    found = {n: both(F.col(f"_s_{n}"), F.col(f"_i_{n}")) for n, (_, _, both) in folds.items()}
    return within.join(starts, by).withColumns(found).drop(*by, *(f"_{p}_{n}" for n in folds for p in "vis"))


def running_total(rows: DataFrame, groups: list[str], order: list, lot: Column, value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the group up to and with each; see running."""
    return running(rows, groups, order, lot, sums={name: value.cast("long")})


def number_rows(rows: DataFrame, groups: list[str], order: list, lot: Column, name: str = "number") -> DataFrame:
    """rows with their number (from 1) in each group by `order`; see running."""
    return running_total(rows, groups, order, lot, F.lit(1), name)
