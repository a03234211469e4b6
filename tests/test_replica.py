"""Replicas converge, whatever the size of their pages and the order of their deliveries."""

import random

from pyspark.sql import functions as F

from tidemark.operators import feed, replica

CHANGES = "id string, document string, version long"


def empty(spark):
    return spark.createDataFrame([], replica.RECORD)


def state(records):
    return sorted((r["id"], r["current"], r["base_version"]) for r in records.collect())


def test_any_page_size_gives_the_same_replica(spark):
    rng = random.Random(1)
    log = [("s", f"d{rng.randrange(12)}", v, rng.random() < 0.2) for v in range(1, 61)]
    changelog = spark.createDataFrame(log, "scope string, id string, version long, deleted boolean").withColumn("document", F.concat("id", F.lit("@"), "version"))
    docs = feed.latest(changelog, ["scope", "id"]).cache()
    want = sorted((r["id"], r["document"], r["version"]) for r in docs.collect())
    for size in (3, 100):
        records, since, more = empty(spark), 0, True
        while more:
            page = feed.pull_page(docs, since, size).cache()
            rows = page.collect()
            records = spark.createDataFrame(replica.apply_remote(records, page.select("id", "document", "version"), 0).collect(), replica.RECORD)
            more, since = rows[0]["has_more"], rows[0]["checkpoint"]
        assert state(records) == want


def test_late_and_repeated_deliveries_change_nothing(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    records = replica.apply_remote(empty(spark), page(("a", "a2", 2), ("b", "b3", 3)), 0)
    again = replica.apply_remote(records, page(("a", "a1", 1), ("b", "b3", 3)), 0)
    assert state(again) == state(records) == [("a", "a2", 2), ("b", "b3", 3)]
    # After a reset an older version of the new generation replaces.
    reset = replica.apply_remote(records, page(("a", "a1", 1)), 1)
    assert state(reset)[0] == ("a", "a1", 1)


def test_an_edit_meets_a_newer_server_state(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    records = replica.apply_remote(empty(spark), page(("a", "a1", 1)), 0)
    writes = spark.createDataFrame([("a", "mine", False, None), ("gone", None, True, None)], "id string, document string, delete boolean, group_id string")
    edited = replica.write(records, writes)
    assert state(edited) == [("a", "mine", 1)]
    observed = replica.apply_remote(edited, page(("a", "a5", 5)), 0).first()
    assert (observed["current"], observed["observed"], observed["observed_version"], observed["is_dirty"]) == ("mine", "a5", 5, True)
    reverted = replica.revert(replica.apply_remote(edited, page(("a", "a5", 5)), 0), F.lit(True)).first()
    assert (reverted["current"], reverted["base_version"], reverted["is_dirty"], reverted["observed"]) == ("a5", 5, False, None)


def test_only_the_sent_revision_becomes_clean(spark):
    base = {"id": "a", "current": "mine", "base": "a1", "base_version": 1, "is_dirty": True, "local_revision": 2, "pending_op": "op", "pending_revision": 2, "pending_group": None, "rejection": None, "observed": None, "observed_version": None, "generation": 0, "missing": False, "conflict": None, "conflict_version": None, "group_id": None}
    rows = [base, base | {"id": "b", "pending_op": "op2", "pending_revision": 1}, base | {"id": "c", "pending_op": "op3", "observed": "c9", "observed_version": 9}, base | {"id": "d", "pending_op": "op4"}]
    records = spark.createDataFrame([tuple(r[c] for c in replica.COLUMNS) for r in rows], replica.RECORD)
    out = spark.createDataFrame([(o, "accepted", 6, f"new-{o}", None) for o in ("op", "op2", "op3")] + [("op4", "rejected", None, None, "base-expired"), ("stale", "accepted", 7, "x", None)], "operation_id string, kind string, version long, document string, error_code string")
    got = {r["id"]: r for r in replica.acknowledge(records, out, 0).collect()}
    assert (got["a"]["current"], got["a"]["is_dirty"], got["a"]["base_version"], got["a"]["pending_op"]) == ("new-op", False, 6, None)
    assert (got["b"]["current"], got["b"]["is_dirty"], got["b"]["base"]) == ("mine", True, "new-op2")
    assert (got["c"]["current"], got["c"]["base_version"], got["c"]["observed"]) == ("c9", 9, None)  # clean, so it adopts what it had observed
    assert (got["d"]["rejection"], got["d"]["base"], got["d"]["base_version"], got["d"]["is_dirty"]) == ("base-expired", None, None, True)


def test_batches_are_those_of_recursive_halving(spark):
    rng = random.Random(3)

    def halves(units, low):
        if len(units) == 1 or sum(units) <= 1000:
            return [(low, low + len(units))] * len(units)
        half = len(units) // 2
        return halves(units[:half], low) + halves(units[half:], low + half)

    for n in (1, 2, 7, 50):
        sizes = [rng.choice((10, 100, 700, 1500)) for _ in range(n)]
        df = spark.createDataFrame([(n, i, s) for i, s in enumerate(sizes)], "request long, pos long, bytes long")
        got = [(r["batch_from"], r["batch_to"], r["too_large"]) for r in replica.batches(df, 1000, ["request"]).orderBy("pos").collect()]
        assert got == [(*span, sizes[i] > 1000 and span[1] - span[0] == 1) for i, span in enumerate(halves(sizes, 0))]
