"""JSON merge against a recursive model, topological order against depth-first search, stored layouts against plain sorting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.graphs import ancestors_first
from tidemark.operators.json_merge import merge_json
from tidemark.sources import layouts

ABSENT = object()


def plain_merge(b, l, s, path, sets, counters, faults):
    if l == s or b == s:
        return l
    if b == l:
        return s
    if path in sets:
        b, l, s = ([] if x is ABSENT or not isinstance(x, list) else x for x in (b, l, s))
        out = [x for x in s if x in l or x not in b] + [x for x in l if x not in b and x not in s]
        return [x for i, x in enumerate(out) if x not in out[:i]]
    if path in counters:
        b, l, s = (0 if x is ABSENT or x is None else x for x in (b, l, s))
        return s + l - b
    if all(isinstance(x, dict) for x in (b, l, s)):
        out = {}
        for name in dict.fromkeys([*sorted(s), *sorted(l), *sorted(b)]):
            value = plain_merge(*(x.get(name, ABSENT) for x in (b, l, s)), path + "/" + name.replace("~", "~0").replace("/", "~1"), sets, counters, faults)
            if value is not ABSENT:
                out[name] = value
        return out
    faults.append(path or "/")
    return s


def check_merge(spark, rows, sets=(), counters=()):
    docs = spark.createDataFrame([(i, *(None if x is None else json.dumps(x) for x in r)) for i, r in enumerate(rows)], "id int, base string, local string, server string").repartition(3)
    got = {r["id"]: r for r in merge_json(docs, sets, counters).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        faults = []
        want = plain_merge(*({} if x is None else x for x in r), "", sets, counters, faults)
        assert json.loads(got[i]["json"]) == want and sorted(got[i]["conflicts"]) == sorted(faults), (r, got[i], want, faults)


def nested(depth, leaf):
    return leaf if depth == 0 else {"k": nested(depth - 1, leaf), "o": depth}


def test_deep_documents(spark):
    rows = [(nested(n, {"x": 1, "y": 1}), nested(n, {"x": 2, "y": 1}), nested(n, {"x": 1, "y": 3})) for n in (0, 1, 5, 50)]
    rows += [(nested(50, {"x": 1}), nested(50, {"x": 2}), nested(50, {"x": 3})), (None, {"a": 1}, {"b": 2}), (None, None, None), ({}, {"a": {}}, {"a": None}), ({"a": [1, {"z": 2}]}, {"a": [1]}, {"a": [2]})]
    check_merge(spark, rows)


def test_random_documents(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return {rng.choice(("a", "b/c", "d~", "é\"'", "tags", "n")): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice((None, True, 3, 4, "x", "2", [], [3, "1"], [{"b": 3, "a": None}], {}))

    def edit(v, depth):
        if isinstance(v, dict) and rng.random() < 0.8:
            return {k: edit(x, depth - 1) for k, x in v.items() if rng.random() < 0.85} | ({rng.choice("abn"): value(max(depth, 0))} if rng.random() < 0.4 else {})
        return value(1) if rng.random() < 0.3 else v

    rows = []
    for _ in range(150):
        base = {"a": value(3), "b": value(2), "tags": [rng.choice("xyz") for _ in range(rng.randint(0, 3))], "deep": {"n": rng.randint(0, 9), "tags": ["q"]}}
        sides = [{k: edit(v, 3) for k, v in base.items()} | ({rng.choice('abn'): value(2)} if rng.random() < 0.3 else {}) for _ in range(2)]
        for side in sides:
            side["tags"] = [t for t in base["tags"] if rng.random() < 0.7] + ([rng.choice("vwx")] if rng.random() < 0.5 else [])
            side["deep"] = {"n": base["deep"]["n"] + rng.choice((0, 0, 3, -2)), "tags": rng.choice((["q"], ["q", "r"], [], ["s"]))}
        rows.append((base, *sides))
    check_merge(spark, rows, {"/tags", "/deep/tags"}, {"/deep/n"})


def plain_depths(nodes, edges):
    needs = {n: {m for a, m in edges if a == n and m in nodes} for n in nodes}
    depth = {}
    while True:
        ready = {n: max((depth[m] + 1 for m in needs[n]), default=0) for n in nodes if n not in depth and needs[n] <= depth.keys()}
        if not ready:
            return {n: depth.get(n) for n in nodes}
        depth |= ready


def test_order_of_random_graphs(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(60)]
    for shape in (0, 1):
        edges = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a > b or (shape and rng.random() < 0.04)] + [("n5", "gone"), ("n3", None)] * 2
        for most in (200_000, 25, 0):  # at once, the rest at once, level by level
            found = ancestors_first(spark.createDataFrame([(n,) for n in nodes] * 2, "node string"), spark.createDataFrame(edges, "node string, needs string"), most)
            assert {r["node"]: r["depth"] for r in found.collect()} == plain_depths(set(nodes), edges) and found.count() == 60
    empty = ancestors_first(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, needs string"))
    assert empty.count() == 0


def test_long_chains_in_large_graphs(spark):
    """A hundred thousand nodes, a chain of a thousand, a cycle with what depends on it."""
    n = F.col("id")
    nodes = spark.range(100_000).select(n.alias("node"))
    edges = spark.range(100_000).select(n.alias("node"), F.when(n < 1000, n - 1).when(n % 7 == 0, n % 1000).when(n.between(5000, 5003), 5000 + (n + 1) % 4).when(n == 9999, 5001).alias("needs"))
    depth = {r["node"]: r["depth"] for r in ancestors_first(nodes, edges).collect()}
    cycle = {5001, 5002, 5003} | {9999}
    assert len(depth) == 100_000 and depth[999] == 999 and depth[0] == 0
    for k in (7000, 7007, 99_995):
        assert depth[k] == (k % 1000) + 1 if k % 7 == 0 else depth[k] == 0
    assert {k for k, d in depth.items() if d is None} <= cycle | {5000}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    keys = ["0", "s", "sz", "s😀", "s～", "sé", "s￿", "saa", "sa"]
    rows = sorted({("name", rng.choice(keys), f"i{rng.choice(('', '😀', '～'))}{rng.randrange(40)}") for _ in range(200)} | {("other", "sz", "x")})
    path = f"{tmp_path_factory.mktemp('index')}/i"
    layouts.write_index(spark.createDataFrame(rows, "index string, key string, id string"), path, files=6)
    units = lambda r: (r[1].encode("utf-16-be"), r[2].encode("utf-16-be"))
    return layouts.read_index(spark, path), sorted((r for r in rows if r[0] == "name"), key=units), units


def test_index_walk(index):
    """Pages by ordinal order, walked to the end both ways; no row is skipped where UTF-8 order differs."""
    stored, rows, _ = index
    for down in (False, True):
        seen, cursor = [], None
        while True:
            page = layouts.index_page(stored, "name", 37, down, **({} if cursor is None else {"before" if down else "after": cursor})).collect()
            if not page:
                break
            seen += [tuple(r) for r in page]
            cursor = seen[-1]
        assert seen == [r[1:] for r in (rows[::-1] if down else rows)]


def test_index_bounds(index):
    stored, rows, units = index
    u = lambda t: t.encode("utf-16-be")
    for low, high, li, hi in (("s", "s😀", True, True), ("s", "s😀", False, False), ("sa", None, True, True), (None, "s～", True, False), ("s～", "s😀", True, True)):
        want = [r[1:] for r in rows if (low is None or (u(r[1]) >= u(low) if li else u(r[1]) > u(low))) and (high is None or (u(r[1]) <= u(high) if hi else u(r[1]) < u(high)))]
        assert [tuple(r) for r in layouts.index_page(stored, "name", 999, low=low, high=high, low_inclusive=li, high_inclusive=hi).collect()] == want
        assert layouts.index_count(stored, "name", low=low, high=high, low_inclusive=li, high_inclusive=hi).first()["n"] == len(want)
    plan = layouts.index_page(stored, "name", 5, low="sa", after=("sa", "i1"))._jdf.queryExecution().toString()
    assert "GreaterThan(at" in plan and "PartitionFilters: [isnotnull(index" in plan


def test_pages_for_many_cursors(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, v, f"d{v}") for s in ("a", "b") for v in rng.sample(range(3000), 700)]
    layouts.write_feed(spark.createDataFrame(rows, "scope string, version long, id string"), f"{tmp_path}/f", width=256)
    stored = spark.read.parquet(f"{tmp_path}/f")
    cursors = [(c, rng.choice(("a", "b", "none")), rng.choice((0, 2999, 3500, rng.randrange(3000)))) for c in range(40)]
    want = []
    for c, s, since in cursors:
        own = sorted(r for r in rows if r[0] == s and r[1] > since)
        page, more = own[:25], len(own) > 25
        want += [(c, v, d, more, page[-1][1]) for _, v, d in page] or [(c, None, None, False, since)]
        if s != "none":
            assert [r["version"] for r in layouts.pull_page(stored, s, since, 25, width=256).collect()] == [r[1] for r in page]
    got = layouts.pages(stored, spark.createDataFrame(cursors, "cursor int, scope string, since long"), 25, width=256)
    assert sorted((tuple(r[k] for k in ("cursor", "version", "id", "has_more", "checkpoint")) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.filter(F.col("scope").isNull()).count() == 0
