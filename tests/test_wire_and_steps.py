import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators import feed, merge, queries, readmodel, replica
from tidemark.sources import stores

DOCUMENT = {"id": "ノート-😀", "updatedAt": "001790000000000:000000:device-a", "deleted": False, "title": "Grüße", "amount": 12345678901234567.89, "colour": "unknown"}
CHANGE = {"document": DOCUMENT, "version": "9007199254740993"}
PAGE = {"changes": [CHANGE], "checkpoint": "c~A:17", "hasMore": True}


def changed(of, **members):
    return {k: v for k, v in (of | members).items() if v is not ...}


def faults(spark, fault, bodies):
    rows = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)], "n int, raw string")
    return [r["f"] for r in rows.select("n", fault(F.col("raw")).alias("f")).orderBy("n").collect()]


def test_pull_requests(spark):
    sound = [{"checkpoint": None, "limit": 100}, {"checkpoint": "c:9007199254740993", "limit": 2}, {"checkpoint": "c", "limit": 1, "features": ["removals"], "replica": "r", "later": {}}]
    wrong = [({"checkpoint": 5, "limit": 10}, "checkpoint"), ({"limit": 1}, "checkpoint"), ({"checkpoint": None}, "limit"), ({"checkpoint": None, "limit": 1.5}, "limit"), ("null", "json"), ("", "json"), ({"checkpoint": None, "limit": 1, "features": "all"}, "features")]
    assert faults(spark, wire.pull_request_fault, sound) == [None] * len(sound)
    assert faults(spark, wire.pull_request_fault, [b for b, _ in wrong]) == [f for _, f in wrong]


def test_pull_results(spark):
    sound = [PAGE, changed(PAGE, changes=[], checkpoint=None), changed(PAGE, removals=["a"], features=["x"], limits={"maxPageSize": 1}, serverTime="1790000000000", retentionHorizon="3500")]
    of = lambda **m: changed(PAGE, changes=[CHANGE, changed(CHANGE, **m)])
    wrong = [(changed(PAGE, hasMore=...), "has-more"), (changed(PAGE, checkpoint=...), "checkpoint"), (changed(PAGE, changes=None), "changes")]
    wrong += [(of(version=v), "version") for v in ("042", "-1", 42, "9223372036854775808", None, ...)]
    wrong += [(of(document=d), "document") for d in (None, changed(DOCUMENT, updatedAt="2026-09-27T10:15:00Z"), changed(DOCUMENT, id=7), changed(DOCUMENT, deleted=...))]
    wrong += [(changed(PAGE, serverTime=5), "server-time"), (changed(PAGE, retentionHorizon="-5"), "retention-horizon"), (changed(PAGE, removals=["a", None]), "removals")]
    assert faults(spark, wire.pull_result_fault, sound) == [None] * len(sound)
    assert faults(spark, wire.pull_result_fault, [b for b, _ in wrong]) == [f for _, f in wrong]


def test_push_results(spark):
    one = lambda **m: {"outcomes": [{"operationId": "o", "kind": "accepted", "version": "1"}, changed({"operationId": "p", "kind": "conflict"}, **m)]}
    assert faults(spark, wire.push_result_fault, [{"outcomes": []}, one(), one(kind="retry-later", arguments={"a": "b"})]) == [None] * 3
    assert faults(spark, wire.push_result_fault, [{}, one(kind=0), one(kind="maybe"), one(operationId=...), one(version=1)]) == ["outcomes", "kind", "kind", "operation-id", "version"]


def merged(spark, base, local, server):
    text = lambda v: None if v is None else json.dumps(v)
    row = spark.createDataFrame([tuple(map(text, (base, local, server)))], "b string, l string, s string").select(merge.merge_members(F.col("b"), F.col("l"), F.col("s")).alias("m")).first()["m"]
    return json.loads(row["json"]), row["conflicts"]


def test_members_without_a_schema_merge(spark):
    assert merged(spark, {"a": 1, "b": None}, {"a": 2, "b": None}, {"a": 1}) == ({"a": 2}, [])
    assert merged(spark, {"a": 1}, {}, {"a": None}) == ({"a": None}, ["/a"])
    assert merged(spark, {"o": {"x": 1, "y/~": 1}}, {"o": {"x": 2, "y/~": 2}}, {"o": {"x": 1, "y/~": 3, "z": "\"q\""}}) == ({"o": {"x": 2, "y/~": 3, "z": '"q"'}}, ["/o/y~1~0"])
    assert merged(spark, {"o": {"p": {"x": 1}}}, {"o": {"p": {"x": 2}}}, {"o": {"p": {"x": 3}, "n": 1}}) == ({"o": {"p": {"x": 3}, "n": 1}}, ["/o/p/x"])
    assert merged(spark, {"o": {"b": 1, "a": 2}}, {"o": {"a": 2, "b": 1}}, {"o": 5}) == ({"o": 5}, [])
    assert merged(spark, None, {"n": "5"}, {"n": 5}) == ({"n": 5}, ["/n"])


def test_tokens_of_doubles_are_their_bits(spark):
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.pi, 2.0**52 + 1, 0.1, 1 - 2.0**-53, 1 + 2.0**-52]
    values += [2.0**e * f for e in range(-1022, 1020, 37) for f in (1.0, 1.9999999999999998, -1.3)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", queries.key_token(F.col("v"), "real").alias("t")).collect()
    for r in rows:
        bits = struct.unpack(">Q", struct.pack(">d", r["v"] + 0.0))[0]
        assert r["t"] == f"4{bits ^ (2**64 - 1) if bits >> 63 else bits | 1 << 63:016x}", r["v"]
    assert [r["v"] for r in sorted(rows, key=lambda r: r["t"])] == sorted(values)


def test_updates_come_once_and_commit_with_their_cursor(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    records = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    updates = spark.createDataFrame([("b", 3, False), ("c", 4, False), ("a", 9, True)], "id string, v int, keep boolean")
    after = replica.updated(records, updates, F.col("keep"))
    assert sorted(map(tuple, after.collect())) == [("a", 1, False), ("b", 3, True), ("c", 4, True)]
    for bad in ([("a", 1, False), ("a", 2, True)], [(None, 1, False)]):
        with pytest.raises(ValueError):
            replica.updated(records, spark.createDataFrame(bad, updates.schema), F.col("keep"))
    assert stores.stored_records(spark, path) is None
    assert stores.commit_records(records, ("e~:1", 1), path) == 1
    assert stores.commit_records(after.drop("changed"), ("e~:2", 1), path) == 2
    records.write.parquet(f"{path}/records/step=3")  # a writer that was lost before its cursor
    rows, cursor, number = stores.stored_records(spark, path)
    assert (rows.count(), cursor, number) == (3, ("e~:2", 1), 2)


def test_retired_generations_go(spark, tmp_path):
    path = f"file://{tmp_path}"
    for i in range(4):
        readmodel.rebuild(spark.range(i + 3).select(F.format_string("r%d", "id").alias("id")), path, f"g{i}")
    spark.range(1).write.parquet(f"{path}/generations/building")
    assert readmodel.retired(spark, path) == ["g0", "g1", "g2"]
    assert readmodel.collect_retired(spark, path, 2) == ["g0", "g1"] and readmodel.collect_retired(spark, path) == ["g2"] and readmodel.collect_retired(spark, path) == []
    assert [r["id"] for r in readmodel.page(spark, path, "r1", 3).collect()] == ["r2", "r3", "r4"] and (tmp_path / "generations/building").exists()


def test_retention_refuses_short_receipts(spark):
    empty = spark.createDataFrame([], "scope string, id string, version long, deleted boolean, kind string, head long, at long, purged_through long")
    for horizons in ((0, None), (10, 9)):
        with pytest.raises(ValueError):
            feed.retention_run(empty, empty, empty, empty, empty, 1, *horizons)


def test_two_writers_of_one_step(spark, tmp_path, monkeypatch):
    """The second writer looked before the first was done: it gets an error, and the first one's records stay."""
    from tidemark.sources import stores

    path = f"{tmp_path}/records"
    assert stores.commit_records(spark.range(3), ("e~:1", 1), path) == 1
    seen, look = stores.stored_records(spark, path), stores.stored_records
    assert stores.commit_records(spark.range(5), ("e~:2", 1), path) == 2
    monkeypatch.setattr(stores, "stored_records", lambda *_: seen)
    with pytest.raises(Exception, match="(?i)exist"):
        stores.commit_records(spark.range(9), ("e~:3", 1), path)
    rows, cursor, number = look(spark, path)
    assert (rows.count(), cursor, number) == (5, ("e~:2", 1), 2)
