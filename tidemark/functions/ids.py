"""Identifiers: validity and order.

Ids are ordered by UTF-16 code units, which differs from the engine's byte order beyond the basic plane; sort
by `id_order` where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_UNITS = 256


def id_order(value: Column) -> Column:
    """Key that sorts as UTF-16 code units do."""
    return F.encode(value, "UTF-16BE")


def utf16_units(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def id_valid(value: Column) -> Column:
    """1 to 256 UTF-16 units without control characters."""
    units = utf16_units(value)
    return F.coalesce((units >= 1) & (units <= MOST_UNITS) & ~value.rlike(r"[\x00-\x1F\x7F-\x9F]"), F.lit(False))
