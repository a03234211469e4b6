"""Page facts, dependency order, carried clocks, requests, groups to send, read models and SQL authorities."""

import random

from pyspark.sql import functions as F

from tidemark.functions import clock, wire
from tidemark.operators import graphs, clocks, feed, numbering, queries, readmodel, replica, status
from tidemark.sources import stores


def order_of(spark, nodes, edges):
    rows = graphs.ancestors_first(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, needs string")).collect()
    return {r["node"]: r["depth"] for r in rows}


def test_dependency_order(spark):
    chain = [f"c{i:03}" for i in range(150)]
    assert order_of(spark, chain, list(zip(chain[1:], chain, strict=False))) == {n: i for i, n in enumerate(chain)}
    diamonds = [(f"t{i}", f"s{i}{x}") for i in range(17) for x in "ab"] + [(f"s{i}{x}", f"t{i - 1}") for i in range(1, 17) for x in "ab"]
    found = order_of(spark, sorted({n for e in diamonds for n in e}), diamonds)
    assert found["t16"] == 33 and found["s0a"] == 0
    # A cycle and what is above it have no place; what is below or beside does. Edges to unknown nodes don't count.
    cyclic = order_of(spark, "abcdef", [("a", "b"), ("b", "a"), ("c", "a"), ("b", "d"), ("e", "d"), ("f", "gone"), ("e", "d")])
    assert cyclic == {"a": None, "b": None, "c": None, "d": 0, "e": 1, "f": 0}
    assert order_of(spark, [], []) == {}


def test_pages_walk_past_what_may_not_be_read(spark):
    docs = spark.createDataFrame([(f"d{v}", v, v % 10 == 0) for v in range(1, 41)], "id string, version long, mine boolean")
    since, seen, calls = 0, [], 0
    while True:
        page = feed.pull_page(docs, since, 7, F.col("mine")).collect()
        seen += [r["id"] for r in page if r["id"] is not None]
        since, calls = page[0]["checkpoint"], calls + 1
        if not page[0]["has_more"]:
            break
    assert seen == ["d10", "d20", "d30", "d40"] and calls == 6 and since == 40
    assert [tuple(r) for r in feed.pull_page(docs.limit(0), 5, 3).collect()] == [(None, None, None, False, 5)]


def test_clocks_carry_as_step_by_step(spark):
    rng, rows, now = random.Random(4), [], 0
    for i in range(400):
        now += rng.choice([0, 0, 0, 1, 9])
        rows.append((i, max(0, now - rng.choice([0, 0, 5])) + 1))
    for counters in (2, 3, 1_000_000):
        got = {r["seq"]: (r["wall"], r["counter"]) for r in clocks.now_stamps(spark.createDataFrame(rows, "seq long, physical long").withColumn("node", F.lit("n")), "node", "seq", "physical", counters).collect()}
        wall, counter = 0, 0
        for i, p in rows:
            wall, counter = (p, 0) if p > wall else (wall, counter + 1)
            if counter == counters:
                wall, counter = wall + 1, 0
            assert got[i] == (wall, counter)
    stamp = spark.range(1).select(clock.encode(F.lit(5), F.lit(1_000_000), F.lit("n"))).first()[0]
    assert stamp == "000000000000006:000000:n"


def test_running_totals_make_their_rows_once(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("other"))
    out = numbering.number_rows(rows, ["g"], ["id"], numbering.lot_of(F.col("id") * 1000))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("Range (") == 1
    assert sorted((r["g"], r["number"]) for r in out.collect()) == sorted((g, 1 + i // 3) for i, g in ((i, i % 3) for i in range(1000)))


def test_base_versions_are_those_of_the_operation(spark):
    stamp = "000000000000005:000000:n"
    body = lambda base, more="": f'{{"operationId":"o","documentId":"d"{base},"document":{{"id":"d","updatedAt":"{stamp}","deleted":false{more}}}}}'
    raws = [body(',"baseVersion":"7"', ',"baseVersion":7'), body(',"baseVersion":7'), body("", ',"baseVersion":"7"'), body(',"baseVersion":null'), body(',"baseVersion":"x"'), body(',"baseVersion":true'), "{"]
    rows = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", "raw", wire.operation(F.col("raw")).alias("op"))
    got = {r["k"]: r["fault"] for r in rows.select("k", wire.operation_fault(F.col("op"), F.col("raw")).alias("fault")).collect()}
    assert [got[i] for i in range(7)] == [None, "base-version-number", "base-version-absent", None, "base-version", "base-version-number", "json"]


def test_groups_are_sent_whole_and_renewed_when_their_size_changes(spark):
    blank = dict.fromkeys(replica.COLUMNS)
    record = lambda i, g, **more: tuple((blank | {"id": i, "is_dirty": True, "group_id": g, "pending_group": g, "pending_op": f"op{i}"} | more).values())
    records = spark.createDataFrame([record("a", "g"), record("b", "g"), record("c", "h"), record("d", "h", rejection="invalid"), record("e", None), record("f", None, pending_op=None), record("g", "k", pending_group="old")], replica.RECORD)
    rows = replica.prepare(records, F.lit(True), F.when(F.col("id") == "b", 3).otherwise(F.when(F.col("group_id") == "k", 1).when(F.col("group_id").isNotNull(), 2).otherwise(0))).collect()
    assert {r["id"]: (r["group_size"], r["renew"]) for r in rows} == {"a": (2, False), "b": (2, True), "e": (0, False), "f": (0, True), "g": (1, True)}


def test_the_newest_generation_is_the_last_one_built(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    for name in ("z", "a", "m"):
        readmodel.rebuild(spark.createDataFrame([(1, name)], "id long, v string"), path, name)
        assert readmodel.active(spark, path).first()["v"] == name


def test_sql_authority(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/authority;create=true"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    documents = spark.createDataFrame([(f"d{i}", i) for i in range(1, 101)], "ID string, VERSION long")  # as Derby folds names
    for name, rows in (("documents", documents), ("receipts", documents.limit(3)), ("feeds", documents.limit(1)), ("document_access", documents.limit(7))):
        rows.write.jdbc(url, f"APP.{name}", properties=driver)
    read = stores.jdbc_authority(spark, url, "APP", partitions=4, **driver)
    assert {k: v.count() for k, v in read.items()} == {"documents": 100, "receipts": 3, "feeds": 1, "access": 7}
    assert read["documents"].rdd.getNumPartitions() == 4 and read["documents"].select(F.sum("version")).first()[0] == 5050


def test_records_are_written_whole_batches_at_a_time(spark):
    records = spark.createDataFrame([("a", 1, "a1"), ("b", 5, "b5"), ("c", 2, "c2")], "key string, revision long, value string")
    rows = [(1, "a", 1, "new"), (1, "d", None, "born"), (2, "b", 4, "stale"), (2, "c", 2, "lost"), (3, "a", 1, "late"), (3, "e", None, "late"), (4, "c", 2, None), (5, "f", None, "fenced")]
    mutations = spark.createDataFrame(rows, "batch long, key string, expected long, value string")
    got = sorted(tuple(r) for r in queries.write_records(records, mutations, F.col("batch") != 5).collect())
    assert got == [("a", 2, "new"), ("b", 5, "b5"), ("d", 1, "born")]
