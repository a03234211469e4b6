"""Owners of cached blobs and pages of any size, on small tables."""

from pyspark.sql import functions as F

from tidemark.operators import content, feed

H = [c * 64 for c in "abcdef"]


def test_inventory_keeps_what_is_unknown(spark):
    entries = spark.createDataFrame(
        [(H[0], 100, [f"reader-v2/{H[1]}", "custom", f"snapshot-v2/{H[2]}"]), (H[1], 7, []), (H[2], 50, [f"reader-v2/{H[3]}", "reader-v2/short"]), (H[3], 5, None)], "sha256 string, bytes long, owners array<string>"
    )
    files = spark.createDataFrame([(H[0], 20, 3), (H[2], None, 4), (H[4], 9, 0), (H[5], None, 8)], "sha256 string, size long, partial long")
    lifetimes = spark.createDataFrame([(H[1],), (H[1],)], "name string")
    got = {r["sha256"]: (r["bytes"], r["owners"]) for r in content.inventory(entries, files, lifetimes).collect()}
    # The second is read by name only, so its lock can't be asked for and it stays; an unfinished file without an entry is none.
    assert got == {H[0]: (100, [f"reader-v2/{H[1]}", "custom"]), H[1]: (0, []), H[2]: (50, ["reader-v2/short"]), H[3]: (0, []), H[4]: (9, ["recovered/unknown"])}


def test_owners_of_other_contents_are_never_released(spark):
    up = f"transfers/{H[0]}/up/"
    entries = spark.createDataFrame([(H[0], 10, [up + H[0], up + H[1], "transfers/x", "", "app/1", "app/1"]), (H[1], 20, []), (H[2], 40, ["app/2"])], "sha256 string, bytes long, owners array<string>")
    none = lambda s: spark.createDataFrame([], s)
    hosts = spark.createDataFrame([(H[2], "app/2", "released"), (H[2], "app/1", "released")], "sha256 string, owner string, resolution string")
    states = content.owner_states(
        entries, none("name string"), none("package string, revision string, package_id string, revision_id string, items array<string>"), none("package string, payload string"),
        none("key string, sha256 string, size long, direction string, schema int"), none("key string, payload string"), none("key string, sha256 string, state string, schema int"), hosts,
    )
    got = sorted((r["sha256"][0], r["owner"], r["resolution"]) for r in states.collect())
    assert got == sorted([("a", up + H[0], "released"), ("a", up + H[1], "unknown"), ("a", "transfers/x", "unknown"), ("a", "", "unknown"), ("a", "app/1", "unknown"), ("a", "app/1", "unknown"), ("c", "app/2", "released")])
    kept = {r["sha256"]: r["owners"] for r in content.maintained(entries, states).collect()}
    assert up + H[0] not in kept[H[0]] and len(kept[H[0]]) >= 4 and kept[H[1]] == [] and kept[H[2]] == []
    assert tuple(content.maintenance_totals(entries, states).first()) == (7, 0, 2, 5, 0, 10)


def test_page_facts_need_no_row_of_all_payloads(spark):
    docs = spark.range(1, 3000).select(F.col("id").alias("version"), F.lit("x").alias("payload"))
    page = feed.pull_page(docs, 10, 1000, F.col("version") % 2 == 0)
    assert "collect_list" not in page._jdf.queryExecution().optimizedPlan().toString()
    rows = page.collect()
    assert [r["version"] for r in rows] == list(range(12, 1011, 2)) and {(r["has_more"], r["checkpoint"]) for r in rows} == {(True, 1010)}
    last = feed.pull_page(docs, 2900, 99).collect()
    assert len(last) == 99 and {(r["has_more"], r["checkpoint"]) for r in last} == {(False, 2999)}
    none = feed.pull_page(docs, 2990, 5, F.lit(None).cast("boolean")).collect()
    assert [(r["version"], r["payload"], r["has_more"], r["checkpoint"]) for r in none] == [(None, None, True, 2995)]
