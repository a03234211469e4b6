import pytest
from pyspark.sql import functions as F

from tidemark.operators import feed, packages, readmodel
from tidemark.streaming import feeds, stateful

OPS = "scope string, pos long, operation_id string, document_id string, base_version long, body_id string, updated_at string, payload string, `group` string, group_size int"


def test_read_model_switches_whole_generations(spark, tmp_path):
    path = f"file://{tmp_path}"
    readmodel.rebuild(spark.range(5), path, "g1")
    readmodel.rebuild(spark.range(7), path, "g2")
    assert readmodel.active(spark, path).count() == 7
    with pytest.raises(ValueError):
        readmodel.rebuild(spark.range(3).union(spark.range(3)), path, "g3")
    assert readmodel.active(spark, path).count() == 7


def test_backup_goes_on_under_a_new_epoch(spark, tmp_path):
    feeds_ = spark.createDataFrame([("s", 10, "e1"), ("t", 99, "e1")], "scope string, head long, epoch string")
    readmodel.backup({"feeds": feeds_, "documents": spark.range(3)}, f"file://{tmp_path}")
    back = readmodel.restore(spark, f"file://{tmp_path}", ["feeds", "documents"], 50, "e2")
    assert sorted(map(tuple, back["feeds"].collect())) == [("s", 50, "e2"), ("t", 99, "e2")] and back["documents"].count() == 3


def test_streamed_changes_compact_to_the_latest(spark, sf, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 4).alias("scope"), F.col("user_id").alias("id"), (F.col("event_id") + 1).alias("version"), "event_type")
    events.repartition(5).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    feeds.compacted(stream, f"file://{tmp_path}/out", ["scope", "id"], f"{tmp_path}/cp").awaitTermination(300)
    got = feeds.newest(spark, f"file://{tmp_path}/out", ["scope", "id"]).select(*events.columns)
    want = feed.latest(events, ["scope", "id"]).select(*events.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_pushes_are_decided_once(spark, tmp_path):
    stateful.use_state_store(spark)
    stamp = "000000000000001:000000:n"
    op = lambda pos, o, d, base, payload: ("s", pos, o, d, base, d, stamp, payload, None, 0)
    batches = [
        [op(1, "op1", "a", None, "a1"), op(2, "op2", "b", None, "b1")],
        [op(1, "op1", "a", None, "a1"), op(2, "op3", "b", 2, "b2"), op(3, "op4", "c", None, "c1")],
        [op(1, "op5", "a", None, "a2"), op(2, "op3", "b", 2, "b2")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(OPS).parquet(f"{tmp_path}/in/*")
        feeds.kept(stateful.pushed(stream, 0), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(300)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["document_id"], r["version"]) for r in out if r["kind"] == "accepted"} == {("a", 1), ("b", 2), ("b", 3), ("c", 4)}
    last = max(r["batch"] for r in out)
    assert {(r["operation_id"], r["kind"], r["duplicate"]) for r in out if r["batch"] == last} == {("op5", "conflict", False), ("op3", "accepted", True)}


def test_late_commits_raise_no_hint(spark, tmp_path):
    rows = [[("2024-01-01 00:00:01", "s", 1)], [("2024-01-01 01:00:00", "s", 2)], [("2024-01-01 00:00:02", "s", 3), ("2024-01-01 01:00:01", "s", 4)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "at string, scope string, version long").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("at timestamp, scope string, version long").parquet(f"{tmp_path}/in/*")
        feeds.kept(feeds.hints(stream, "at"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(300)
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("at").agg(F.max("version").alias("v"), F.max("n").alias("n")).orderBy("at").collect()
    assert [(r["v"], r["n"]) for r in out] == [(1, 1), (4, 2)]


def test_hints_coalesce(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("2024-01-01 00:00:01", "s", 1), ("2024-01-01 00:00:02", "s", 2), ("2024-01-01 00:00:02", "t", 3), ("2024-01-01 00:10:00", "s", 4)]
    df = spark.createDataFrame(rows, "at string, scope string, version long").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(source))
    stream = feeds.hints(spark.readStream.schema(df.schema).parquet(str(source)), "at")
    stream.writeStream.outputMode("complete").format("memory").queryName("hints").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    assert {(r["scope"], r["n"], r["version"]) for r in spark.sql("select * from hints").collect()} == {("s", 2, 2), ("t", 1, 3), ("s", 1, 4)}


def test_cycles_and_closures(spark):
    items = spark.createDataFrame([("p", "a", ["b"]), ("p", "b", ["c"]), ("p", "c", ["a"]), ("q", "a", ["b"]), ("q", "b", []), ("r", "x", ["x"])], "package string, id string, dependencies array<string>")
    assert {r["package"] for r in packages.cyclic(items).collect()} == {"p", "r"}
    roots = spark.createDataFrame([("p", "a"), ("q", "b")], "package string, id string")
    assert {tuple(r) for r in packages.closure(roots, packages.edges(items)).collect()} == {("p", "a"), ("p", "b"), ("p", "c"), ("q", "b")}


def test_json_documents_keep_what_they_do_not_know(spark, tmp_path):
    from tidemark.sources.stores import json_documents, to_json_documents

    lines = ['{"id":"a","updated_at":"x","deleted":false,"title":"t","later":{"n":1},"flag":true,"note":"say \\"hi\\""}', '{"id":"b","updated_at":"y","deleted":true}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    docs = json_documents(spark, str(tmp_path / "d.json"), "title STRING")
    rows = {r["id"]: r for r in docs.collect()}
    assert rows["a"]["title"] == "t" and rows["a"]["_unknown"]["later"] == '{"n":1}' and rows["b"]["deleted"]
    import json

    assert sorted((json.loads(r["value"]) for r in to_json_documents(docs).collect()), key=str) == sorted(map(json.loads, lines), key=str)


def test_flat_records_and_blob_files(spark, tmp_path):
    from tidemark.sources.stores import blob_files, flat_records, write_feed

    rows = flat_records(spark.createDataFrame([("a", "9007199254740993", "01", True)], "id string, base_version string, observed_version string, is_dirty boolean")).first()
    assert (rows["base_version"], rows["observed_version"], rows["is_dirty"], rows["missing"]) == (9007199254740993, None, True, None)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"abc")
    blob = blob_files(spark, str(tmp_path / "b")).first()
    assert (blob["id"], blob["size"], blob["sha256"][:8]) == ("x.bin", 3, "ba7816bf")
    write_feed(spark.range(10).select(F.col("id").alias("version"), (F.col("id") % 2).alias("scope")), f"{tmp_path}/feed")
    assert spark.read.parquet(f"{tmp_path}/feed").filter("scope = 1 and version > 5").count() == 2
