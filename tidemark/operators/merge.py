"""Conflicts: policies and the three-way merge as generated expressions.

The merge works on structs. For every field of the base's type an expression is generated: equal changes and one-sided
ones are taken, structs recurse, declared sets and counters combine, everything else that both sides changed differently
is a conflict, keeps the server's value and names its JSON-pointer path.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pointer(path: str, key: str) -> str:
    return f"{path}/{key.replace('~', '~0').replace('/', '~1')}"


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def merge_set(base: Column, local: Column, server: Column) -> Column:
    """Server order, then local additions; what either side removed is gone; null-safe and without repeats."""
    items = [F.coalesce(x, F.array()) for x in (base, local, server)]
    b, l, s = items
    has = lambda items, x: F.exists(items, lambda y: y.eqNullSafe(x))
    return F.array_distinct(F.concat(F.filter(s, lambda x: has(l, x) | ~has(b, x)), F.filter(l, lambda x: ~has(b, x) & ~has(s, x))))


def merge_counter(base: Column, local: Column, server: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0))
    return zero(server) + (zero(local) - zero(base))


def merge_slot(kind: T.DataType, base: Column, local: Column, server: Column, path: str, sets: Collection[str], counters: Collection[str]) -> tuple[Column, list[tuple[Column, str]]]:
    """(value, [(condition, path of a conflict)]) of one slot."""
    if isinstance(kind, T.StructType) and path not in sets and path not in counters:
        fields, faults = [], []
        whole = base.isNotNull() & local.isNotNull() & server.isNotNull()
        for f in kind.fields:
            value, own = merge_slot(f.dataType, base[f.name], local[f.name], server[f.name], pointer(path, f.name), sets, counters)
            fields.append(value.alias(f.name))
            faults += own
        inner = F.struct(*fields)
        untouched = same(local, server) | same(base, server)
        value = F.when(untouched, local).when(same(base, local), server).when(whole, inner).otherwise(server)
        both = ~untouched & ~same(base, local)
        return value, [(both & ~whole, path or "/"), *((both & whole & c, p) for c, p in faults)]
    untouched = same(local, server) | same(base, server)
    value = F.when(untouched, local).when(same(base, local), server)
    if path in sets:
        return value.otherwise(merge_set(base, local, server)), []
    if path in counters:
        return value.otherwise(merge_counter(base, local, server).cast(kind)), []
    return value.otherwise(server), [(~untouched & ~same(base, local), path)]


def three_way(kind: T.StructType, base: Column, local: Column, server: Column, base_deleted: Column, local_deleted: Column, server_deleted: Column, sets: Collection[str] = (), counters: Collection[str] = ()) -> dict[str, Column]:
    """content, deleted, conflicts (array of paths), clean and same_as_server of a merge.

    kind is the type of the content without id, timestamp and deletion flag. If just one side changed the flag, the
    other must not have changed the content; else `(deleted)` is a conflict, which comes first.
    """
    value, faults = merge_slot(kind, base, local, server, "", sets, counters)
    dead = local_deleted & server_deleted
    differ = local_deleted != server_deleted
    local_did = local_deleted != base_deleted
    untouched = F.when(local_did, same(base, server)).otherwise(same(base, local))
    flag = F.when(dead, F.lit(True)).when(differ & untouched, F.when(local_did, local_deleted).otherwise(server_deleted)).otherwise(server_deleted)
    paths = F.filter(F.array(*(F.when(c, F.lit(p)) for c, p in faults)), lambda p: p.isNotNull()) if faults else F.array().cast("array<string>")
    first = F.when(differ & ~untouched, F.array(F.lit("(deleted)"))).otherwise(F.array().cast("array<string>"))
    content = F.when(dead, server).otherwise(value)
    conflicts = F.when(dead, F.array().cast("array<string>")).otherwise(F.concat(first, paths))
    return {
        "content": content, "deleted": flag, "conflicts": conflicts, "clean": F.size(conflicts) == 0,
        "same_as_server": (flag == server_deleted) & (flag | same(content, server)),
    }


def members(json: Column) -> Column:
    """The members of a JSON object as JSON text each, of one form for equal values; a member that is null is the text null."""
    return F.transform_values(F.from_json(json, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def _name(key: Column) -> Column:
    """JSON text of a member's name."""
    return F.regexp_extract(F.to_json(F.struct(key.alias("k"))), r"(?s)^\{.k.:(.*)\}$", 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_members(base: Column, local: Column, server: Column, path: Column | None = None, depth: int = 4) -> Column:
    """struct(json, conflicts): the merge of JSON objects whose members no schema names, null counting as {}.

    Members come in the order of the server, the local side and the base, those of objects within by name. An absent member is not a null one, so one
    side's removal is a change as any other. Objects on all three sides are merged member by member, `depth` levels deep; below that
    they are values as any other.
    """
    at = F.lit("") if path is None else path
    none = F.array().cast("array<string>")
    plain = lambda value, fault: F.struct(value.alias("json"), fault.alias("conflicts"))

    def slot(name: Column, v: Column) -> Column:
        own = F.concat(at, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        both = plain(v["s"], F.array(own))
        if depth > 1:
            objects = F.coalesce(v["b"].startswith("{") & v["l"].startswith("{") & v["s"].startswith("{"), F.lit(False))
            both = F.when(objects, merge_members(v["b"], v["l"], v["s"], own, depth - 1)).otherwise(both)
        value = F.when(same(v["l"], v["s"]) | same(v["b"], v["s"]), plain(v["l"], none)).when(same(v["b"], v["l"]), plain(v["s"], none)).otherwise(both)
        return F.struct(name.alias("name"), value.alias("value"))

    def whole(m: Column) -> Column:
        names = F.array_distinct(F.concat(F.map_keys(m["s"]), F.map_keys(m["l"]), F.map_keys(m["b"])))
        sides = lambda name: F.struct(*(F.try_element_at(m[side], name).alias(side) for side in "bls"))
        return F.transform(names, lambda name: _let(sides(name), lambda v: slot(name, v)))

    def text(slots: Column) -> Column:
        present = F.filter(slots, lambda x: x["value"]["json"].isNotNull())
        body = F.array_join(F.transform(present, lambda x: F.concat(_name(x["name"]), F.lit(":"), x["value"]["json"])), ",")
        return plain(F.concat(F.lit("{"), body, F.lit("}")), F.flatten(F.transform(slots, lambda x: x["value"]["conflicts"])))

    maps = F.struct(*(members(F.coalesce(side, F.lit("{}"))).alias(name) for name, side in (("b", base), ("l", local), ("s", server))))
    return _let(_let(maps, whole), text)


def last_write_wins(fork_at: Column, master_at: Column) -> Column:
    """keep-fork only if the fork's stamp is later; a tie goes to the master."""
    return F.when(fork_at > master_at, "keep-fork").otherwise("use-master")


def merge_decision(has_base: Column, clean: Column, same_as_server: Column, fallback: Column) -> Column:
    """The merge handler: without a base or with conflicts it falls back; equal to the server's state needs no write."""
    return F.when(~has_base | ~clean, fallback).when(same_as_server, "use-master").otherwise("use-resolved")
