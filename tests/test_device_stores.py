"""Stores of devices as SQLite files: round trips, older and newer schemas, damage, indexes, hot devices."""

import json
import sqlite3
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replica
from tidemark.sources import device_stores


def written(spark, tmp_path, stores):
    for name, content in stores.items():
        (tmp_path / name).write_bytes(content)
    return device_stores.device_files(spark, str(tmp_path))


def store(version=5, wal=False, columns=None, rows=(), index=()):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE TABLE bs_records ({columns or device_stores.RECORDS}, PRIMARY KEY (collection, id))")
    if version >= 5:
        con.execute(f"CREATE TABLE bs_index ({device_stores.TABLES['bs_index']}) WITHOUT ROWID")
        con.executemany("INSERT INTO bs_index VALUES (?, ?, ?, ?)", index)
    for r in rows:
        con.execute(f"INSERT INTO bs_records ({', '.join(r)}) VALUES ({', '.join('?' * len(r))})", list(r.values()))
    con.execute(f"PRAGMA user_version = {version}")
    con.commit()
    content = bytearray(con.serialize())
    if wal:
        content[18:20] = b"\2\2"
    return bytes(content)


def record(i, **more):
    return {"collection": "c", "id": i, "id_key": i.encode("utf-16-be"), "current": f'{{"id":"{i}"}}', "updated_at": "t", "deleted": 0, "is_dirty": 0, "local_revision": 1, "generation": 0, "missing": 0} | more


def test_files_of_all_kinds(spark, tmp_path):
    old = ", ".join(c for c in device_stores.RECORDS.split(", ") if not c.startswith(("conflict", "group", "pending_group", "base_same", "rejection_arguments")))
    whole = store(rows=[record(f"x{n}", current="y" * 3000) for n in range(50)])
    damaged = bytearray(whole)
    damaged[4096 * 5 : 4096 * 6] = b"\xa5" * 4096
    files = written(spark, tmp_path, {
        "new.db": store(9, rows=[record("n")]), "old.db": store(1, columns=old, rows=[record("o", base="b", base_version=2**60)]), "torn.db": whole[:9000], "damaged.db": bytes(damaged), "text.db": b"hello", "empty.db": b"",
        "wal.db": store(wal=True, rows=[record("w😀", base_same=1, is_dirty=1, missing=1), record("v", rejection_code="invalid", conflict_local="mine", conflict_server_version=7, pending_id="op", deleted=1)],
                        index=[("c", "name", "s～".encode("utf-16-be"), "w😀".encode("utf-16-be"))]),
    })
    files = files.unionByName(spark.createDataFrame([("none", None), ("zero", b"")], "path string, content binary"))  # the reader doesn't list empty files
    name = F.element_at(F.split("path", "/"), -1)
    states = {r[0]: tuple(r)[1:] for r in device_stores.device_states(files).select(name, "state", "schema", "collections", "n").collect()}
    assert states.pop("old.db") == ("ok", 1, 1, 1) and states.pop("wal.db") == ("ok", 5, 1, 2) and states.pop("new.db")[0] == "newer"
    assert {s[0] for s in states.values()} == {"unreadable"} and set(states) == {"torn.db", "damaged.db", "text.db", "none", "zero"}
    rows = {r["id"]: r for r in device_stores.device_records(files).collect()}
    assert set(rows) == {"o", "w😀", "v"}
    assert rows["o"]["base"] == "b" and rows["o"]["base_version"] == 2**60 and rows["o"]["conflict"] is None
    assert rows["w😀"]["base"] == rows["w😀"]["current"] and rows["w😀"]["is_dirty"] and rows["w😀"]["missing"]
    v = rows["v"]
    assert (v["rejection"], v["conflict"], v["conflict_version"], v["pending_op"], v["deleted"], v["base"]) == ("invalid", "mine", 7, "op", True, None)
    assert [tuple(r)[1:] for r in device_stores.device_indexes(files).collect()] == [("c", "name", "s～", "w😀")]
    assert device_stores.device_records(files.limit(0)).collect() == []


def test_round_trip_and_hot_device(spark):
    """Nulls, equal bases and odd ids survive; a device with most rows becomes several stores, each within reach of the bound."""
    plain = dict.fromkeys(replica.COLUMNS)
    rows = [plain | {"id": f"i{n}", "current": "c", "is_dirty": False, "local_revision": n, "generation": 0, "missing": False} for n in range(900)]
    rows[0] |= {"id": "", "base": "c"}
    rows[1] |= {"id": "é😀\x01", "base": "c", "is_dirty": True, "pending_op": "p", "pending_revision": 1, "group_id": "g", "pending_group": "g"}
    rows[2] |= {"observed": "o", "observed_version": -(2**63), "conflict": "k", "conflict_version": 2**63 - 1, "rejection": "r"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], replica.RECORD).withColumn("device", F.when(F.col("local_revision") % 10 == 0, "small").when(F.col("local_revision") % 10 == 1, None).otherwise("hot")).withColumn("kind", F.lit("k"))
    made = device_stores.to_device_stores(df, "device", "kind", 200).cache()
    assert {r["device"]: r["n"] for r in made.groupBy("device").agg(F.count("*").alias("n")).collect()} == {"small": 1, None: 1, "hot": 4}
    assert made.agg(F.max("n")).first()[0] < 300
    back = device_stores.device_records(made.select(F.col("device").alias("path"), "content"))
    key = lambda r: json.dumps(r, sort_keys=True, default=str)
    assert sorted((r.asDict() for r in back.select(*replica.COLUMNS).collect()), key=key) == sorted(rows, key=key)


def test_tasks_need_no_package(tmp_path):
    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(device_stores._reading("records", [("path", "STRING"), ("id", "STRING")], 5)))
    (tmp_path / "s").write_bytes(store(rows=[record("a")]))
    code = (
        "import pickle, sys, pyarrow as pa; sys.modules['tidemark'] = None; f = pickle.load(open('f', 'rb'));"
        "b = pa.RecordBatch.from_pydict({'path': ['p'], 'content': [open('s', 'rb').read()]}); print([x.to_pylist() for x in f(iter([b]))])"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "[[{'path': 'p', 'id': 'a'}]]", out.stderr


@pytest.mark.parametrize("size", [0, 1, 5])
def test_empty_records(spark, size):
    df = spark.createDataFrame([], replica.RECORD).withColumns({"device": F.lit("d"), "kind": F.lit("k")})
    assert device_stores.to_device_stores(df, "device", "kind", size + 1).count() == 0
