"""Three-way merge of JSON documents of any depth, set-based.

Each side is flattened to rows (id, pointer, parent, name, kind, value), one a member, by exploding objects a level a round, so
the depth costs rounds and not plan size. The three sides meet by pointer, and the decision runs from the root down and back:

- A slot that one side left as it was takes the other side's value whole; so does one that both changed alike.
- A slot that is an object on all three sides is open: its members are slots of their own.
- Declared sets and counters combine, at any pointer.
- Anything else that both sides changed differently is a conflict, keeps the server's value and names its pointer.

Equality of objects is that of their members, whatever their order: every node carries its canonical text (members by name), so two
sides are compared without looking into them, and a document is only opened where they differ. Rebuilding starts at the
deepest open objects: members are put together by parent, a level a round, up to the root. Rounds are stored tables; no
document meets another, and a document's members meet only in their own parent.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import merge_counter, merge_set
from tidemark.sources.scratch import stored

SIDES = ("b", "l", "s")


def canonical(json: Column) -> Column:
    """Text that is the same for equal JSON values: variants keep members by name and numbers in one form."""
    return F.to_json(F.parse_json(json))


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _quoted(name: Column) -> Column:
    """JSON text of a member's name."""
    return F.regexp_extract(F.to_json(F.struct(name.alias("k"))), r"(?s)^\{.k.:(.*)\}$", 1)


def _members(json: Column) -> Column:
    """The members of an object as canonical JSON text each; a member that is null is the text null."""
    return F.transform_values(F.from_json(json, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def _list(json: Column) -> Column:
    """The items of an array as canonical JSON text each; anything else has none."""
    items = F.transform(F.from_json(F.when(json.startswith("["), json), "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    return F.coalesce(items, F.array().cast("array<string>"))


def _decided(slots: DataFrame, sets: Collection[str], counters: Collection[str]) -> DataFrame:
    """slots (id, pointer, b, l, s) with json (null: absent), fault, and open where members decide."""
    b, l, s = (F.col(c) for c in SIDES)
    one_sided = F.when(l.eqNullSafe(s) | b.eqNullSafe(s), l).when(b.eqNullSafe(l), s)
    settled = l.eqNullSafe(s) | b.eqNullSafe(s) | b.eqNullSafe(l)
    is_set, is_counter = F.col("pointer").isin(*sets) if sets else F.lit(False), F.col("pointer").isin(*counters) if counters else F.lit(False)
    opens = ~settled & ~is_set & ~is_counter & F.coalesce(b.startswith("{") & l.startswith("{") & s.startswith("{"), F.lit(False))
    merged = F.concat(F.lit("["), F.array_join(merge_set(_list(b), _list(l), _list(s)), ","), F.lit("]"))
    number = lambda c: F.try_to_number(c, F.lit("S99999999999999999999999999999999999999")).cast("decimal(38,0)")
    counted = merge_counter(number(b), number(l), number(s)).cast("string")
    json = F.when(settled, one_sided).when(is_set, merged).when(is_counter, counted).when(~opens, s)
    fault = ~settled & ~is_set & ~is_counter & ~opens
    return slots.select("id", "pointer", "parent", "name", "place", json.alias("json"), F.coalesce(fault, F.lit(False)).alias("fault"), opens.alias("open"), *SIDES)


def _opened(decided: DataFrame) -> DataFrame:
    """The members of open objects as slots: names of the server's order, then the local side's, then the base's."""
    maps = decided.filter("open").select("id", F.col("pointer").alias("parent"), *(_members(F.col(c)).alias(c) for c in SIDES))
    names = F.array_distinct(F.concat(F.map_keys("s"), F.map_keys("l"), F.map_keys("b")))
    each = maps.select("id", "parent", F.posexplode(names).alias("place", "name"), *SIDES)
    return each.select("id", F.concat("parent", F.lit("/"), _escaped(F.col("name"))).alias("pointer"), "parent", "name", "place", *(F.try_element_at(c, "name").alias(c) for c in SIDES))


def merge_json(docs: DataFrame, sets: Collection[str] = (), counters: Collection[str] = (), id_col: str = "id") -> DataFrame:
    """(id, json, conflicts) of documents (id, base, local, server), JSON text each, to any depth.

    Ids are unique. A document that is null counts as {}. conflicts are pointers in the order of the merged document. Members of the
    result come in the server's order, then local additions; those of values taken whole by name. A counter is a whole
    number of up to 38 digits. Text that isn't JSON gives an error, as it does where it is parsed alone.
    """
    sides = zip(SIDES, ("base", "local", "server"), strict=True)
    roots = docs.select(F.col(id_col).alias("id"), F.lit("").alias("pointer"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), F.lit(0).alias("place"),
                        *(canonical(F.coalesce(F.col(c), F.lit("{}"))).alias(side) for side, c in sides))
    levels = [stored(_decided(roots, sets, counters), "json-level")]
    while levels[-1].filter("open").limit(1).count():
        levels.append(stored(_decided(_opened(levels[-1]), sets, counters), "json-level"))
    # From the deepest level up: an open slot takes the text of its members.
    below = None
    for level in reversed(levels):
        own = F.when(F.col("fault"), F.array(F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")))).otherwise(F.array().cast("array<string>"))
        rows = level.select("id", "pointer", "parent", "name", "place", "json", own.alias("faults"))
        if below is not None:
            inner = below.groupBy(F.col("id").alias("_id"), F.col("parent").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "json", "faults"))).alias("_m"))
            body = F.array_join(F.transform(F.filter("_m", lambda m: m["json"].isNotNull()), lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["json"])), ",")
            joined = rows.join(inner, (F.col("id") == F.col("_id")) & (F.col("pointer") == F.col("_at")), "left")
            text = F.when(F.col("_m").isNotNull(), F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.col("json"))
            faults = F.when(F.col("_m").isNotNull(), F.flatten(F.transform("_m", lambda m: m["faults"]))).otherwise(F.col("faults"))
            rows = joined.select("id", "pointer", "parent", "name", "place", text.alias("json"), faults.alias("faults"))
        below = stored(rows, "json-merged") if len(levels) > 8 else rows
    return below.select(F.col("id").alias(id_col), "json", F.col("faults").alias("conflicts"))
