"""Queries over rows that lack a scope, a position, an access time or a sequence: each has its answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clocks, content, publish, push
from tidemark.plans.pushes import _rules
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.derived import NOW_MS, sql
from tidemark.sources.tables import table


@query(sql("SELECT scope, pos, operation_id, kind, error_code, CAST(version AS BIGINT) AS version FROM pushed UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 's1' END, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey END, 'lost' || o_orderkey, 'rejected', 'invalid', NULL FROM orders WHERE o_orderkey % 6 < 2", "pushed"))
def push_unplaced(spark, sf_dir):
    """Operations without a scope or without a position are answered, and change nothing for the others."""
    k = F.col("o_orderkey")
    ops = derived.operations(spark, sf_dir)
    lost = table(spark, sf_dir, "orders").filter(k % 6 < 2).select(
        F.when(k % 2 == 0, F.lit("s1")).alias("scope"), F.when(k % 2 != 0, k).alias("pos"), derived.text("lost", k).alias("operation_id"), derived.text("lost", k).alias("document_id"), F.lit(None).cast("long").alias("base_version"),
        derived.text("lost", k).alias("body_id"), F.lit("001700000000000:000000:n").alias("updated_at"), F.col("o_orderpriority").alias("payload"), F.lit(None).cast("string").alias("group"), F.lit(0).alias("group_size"),
    )
    done = push.push(ops.unionByName(lost), derived.authority_documents(spark, sf_dir), derived.receipts(ops), derived.authority_feeds(spark, sf_dir), NOW_MS, **_rules())
    return done.select("scope", "pos", "operation_id", "kind", "error_code", "version")


@query("""
    WITH r AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN 's' || (c_custkey % 2) END AS scope, CASE WHEN c_custkey % 13 <> 0 THEN 'n' || c_custkey END AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS pos FROM customer)
    SELECT scope, id, 'written' AS action, row_number() OVER (PARTITION BY scope ORDER BY pos NULLS FIRST, id) + 100 AS version FROM r WHERE scope IS NOT NULL AND id IS NOT NULL
    UNION ALL SELECT scope, id, 'invalid', NULL FROM r WHERE scope IS NULL OR id IS NULL
""")
def publish_unplaced(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(k % 11 != 0, derived.text("s", k % 2)).alias("scope"), F.when(k % 13 != 0, derived.text("n", k)).alias("id"), F.when(k % 7 != 0, k).alias("pos"), F.col("c_name").alias("payload"), F.lit(False).alias("deleted"))
    feeds = spark.createDataFrame([("s0", 100), ("s1", 100)], "scope string, head long")
    return publish.publish(rows, derived.authority_documents(spark, sf_dir), feeds)


@query("""
    WITH f AS (SELECT sha256(p_name || p_partkey) AS sha256, p_size AS length, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 1000 END AS accessed, p_partkey % 10 = 0 AS keep FROM part),
    s AS (SELECT *, sum(length) OVER (ORDER BY accessed NULLS FIRST, sha256) AS upto FROM f WHERE NOT keep)
    SELECT sha256, CAST(length AS BIGINT) AS length, accessed FROM s WHERE (SELECT sum(length) FROM f) - (upto - length) > (SELECT sum(length) // 2 FROM f)
""")
def evict_never_used(spark, sf_dir):
    """Files without an access time go first."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.sha2(F.concat("p_name", k.cast("string")), 256).alias("sha256"), F.col("p_size").cast("long").alias("length"), F.when(k % 3 != 0, k * 1000).alias("accessed"), (k % 10 == 0).alias("keep"))
    budget = files.agg(F.floor(F.sum("length") / 2)).first()[0]
    return content.evict(files, budget, F.col("keep"))


@query("""
    WITH e AS (SELECT event_id, CASE WHEN user_id % 9 <> 0 THEN user_id % 9 END AS node, event_id AS seq, epoch_us(ts) // 1000000 AS t FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS n FROM e), m AS (SELECT *, n + max(t * 1000 - n) OVER (PARTITION BY node ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ticks FROM n)
    SELECT event_id, ticks // 1000 AS wall, ticks % 1000 AS counter FROM m
""")
def hlc_now_of_no_node(spark, sf_dir):
    """Events without a node are a clock of their own, counted as the others."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    rows = e.select("event_id", F.when(u % 9 != 0, u % 9).alias("node"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"))
    return clocks.now_stamps(rows, "node", "seq", "t", 1000).select("event_id", F.col("wall").cast("long").alias("wall"), F.col("counter").cast("long").alias("counter"))
