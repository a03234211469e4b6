"""Queries over states and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graphs, status
from tidemark.plans.querying import _KV, _kv
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.derived import sql
from tidemark.sources.tables import table


@query(sql("""
    , wanted AS (SELECT o_custkey % 100 AS session, 'o' || o_orderkey AS id, o_orderkey % 6 AS revision FROM orders WHERE o_orderkey % 3 = 0),
    j AS (SELECT w.session, coalesce(r.is_dirty AND r.local_revision >= w.revision, false) AS open, r.rejection IS NOT NULL AS rej FROM wanted w LEFT JOIN records r ON w.id = r.id)
    SELECT session, greatest(0, count(*) FILTER (open) - count(*) FILTER (open AND rej)) AS pending, count(*) FILTER (open) AS unaccepted, NOT bool_or(open) AS met FROM j GROUP BY session""", "records"))
def goal_eval(spark, sf_dir):
    k = F.col("o_orderkey")
    wanted = table(spark, sf_dir, "orders").filter(k % 3 == 0).select((F.col("o_custkey") % 100).alias("session"), derived.text("o", k).alias("id"), (k % 6).alias("revision"))
    return status.goal(wanted, derived.records(spark, sf_dir), ["session"])


@query("""
    WITH s AS (SELECT c_custkey % 50 AS account, c_custkey // 50 AS collection, CASE c_custkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'offline' WHEN 2 THEN 'syncing' ELSE 'idle' END AS state, c_custkey % 4 AS pending, c_custkey % 3 AS conflicts, CASE WHEN c_custkey % 97 = 0 THEN c_name END AS detail FROM customer)
    SELECT account, CASE max(CASE state WHEN 'idle' THEN 0 WHEN 'syncing' THEN 1 WHEN 'offline' THEN 2 WHEN 'conflicted' THEN 3 ELSE 4 END) WHEN 0 THEN 'idle' WHEN 1 THEN 'syncing' WHEN 2 THEN 'offline' WHEN 3 THEN 'conflicted' ELSE 'failed' END AS state,
        CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(conflicts) AS BIGINT) AS conflicts, coalesce(string_agg(collection || ': ' || detail, '; ' ORDER BY collection), '') AS detail FROM s GROUP BY account
""")
def coordinator_status(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.when(k % 7 == 0, "failed").when(k % 7 == 1, "offline").when(k % 7 == 2, "syncing").otherwise("idle")
    rows = table(spark, sf_dir, "customer").select((k % 50).alias("account"), F.floor(k / 50).cast("long").alias("collection"), state.alias("state"), (k % 4).alias("pending"), (k % 3).alias("conflicts"), F.when(k % 97 == 0, F.col("c_name")).alias("detail"))
    return status.coordinator(rows, ["account"])


@query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey > 1),
    r(node, depth) AS (SELECT n_nationkey, 0 FROM nation UNION ALL SELECT e.node, r.depth + 1 FROM r JOIN e ON e.needs = r.node WHERE r.depth < 30)
    SELECT node, max(depth) AS depth FROM r GROUP BY node
""")
def dag_order(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    edges = n.filter(k > 0).select(k.alias("node"), F.floor(k / 2).cast("int").alias("needs")).unionByName(n.filter((k % 3 == 1) & (k > 1)).select(k.alias("node"), F.floor(k / 3).cast("int").alias("needs")))
    return graphs.ancestors_first(n.select(k.alias("node")), edges)


@query("SELECT c_custkey, c_custkey % 9 = 0 OR 100 - c_custkey % 100 > 60 AS stale FROM customer")
def staleness(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, status.stale(F.when(k % 9 != 0, k % 100), F.lit(100), F.lit(60)).alias("stale"))


@query("SELECT event_id, least(300000.0::DOUBLE, 1000.0 * pow(2.0, least(n - 1, 30))) AS plain, greatest(least(300000.0::DOUBLE, 1000.0 * pow(2.0, least(n - 1, 30))) * (0.5 + 0.25), CASE WHEN event_id % 4 = 0 THEN 5000.0 ELSE 0.0 END::DOUBLE) AS jittered FROM (SELECT event_id, event_id % 40 + 1 AS n FROM events)")
def backoff(spark, sf_dir):
    n = F.col("event_id") % 40 + 1
    return table(spark, sf_dir, "events").select("event_id", status.backoff(n).alias("plain"), status.backoff(n, jitter=F.lit(0.5), retry_after=F.when(F.col("event_id") % 4 == 0, 5000)).alias("jittered"))


@query(sql("SELECT generation, count(*) AS depth, greatest(0, 60000 - min(k)) AS oldest_age_ms FROM records WHERE is_dirty AND rejection IS NULL GROUP BY generation", "records"))
def queue_gauges(spark, sf_dir):
    records = derived.records(spark, sf_dir).withColumn("wall", F.substring("id", 2, 20).cast("long"))
    return status.queue_gauges(records, ["generation"], "wall", F.lit(60000).cast("long"))


@query(f"""WITH {_KV} SELECT CASE WHEN starts_with(key, 'blob/') THEN 'blob' WHEN starts_with(key, 'job/') THEN 'transfer' WHEN starts_with(key, 'package/') THEN 'package' ELSE 'unsupported' END AS record_kind,
    CASE WHEN moment % 3 = 0 THEN 'none' ELSE 's' || (moment % 3) END AS state, count(*) AS n, greatest(0, 100 - min(moment)) AS oldest_age FROM kv GROUP BY 1, 2""")
def diag_export(spark, sf_dir):
    payload = F.when(F.col("at") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"state":"s'), F.col("at") % 3, F.lit('"}')))
    records = _kv(spark, sf_dir).withColumn("payload", payload)
    return status.diagnostic_export(records, {"blob/": "blob", "job/": "transfer", "package/": "package"}, F.lit(100).cast("long"))


@query(f"""WITH {_KV}, w AS (SELECT *, row_number() OVER (ORDER BY key) AS n FROM kv ORDER BY key LIMIT 601), s AS (SELECT *, moment % 11 = 0 OR starts_with(key, 'x/') AS odd FROM w WHERE n <= 600),
    f AS (SELECT count(*) AS scanned, count(*) FILTER (odd) AS unsupported, (SELECT count(*) > 600 FROM w) AS truncated FROM s)
    SELECT record_kind, state, n, scanned, unsupported, truncated FROM f LEFT JOIN (SELECT CASE WHEN starts_with(key, 'blob/') THEN 'blob' WHEN starts_with(key, 'job/') THEN 'transfer' ELSE 'package' END AS record_kind,
        CASE WHEN moment % 3 = 0 THEN 'none' ELSE 's' || (moment % 3) END AS state, count(*) AS n FROM s WHERE NOT odd GROUP BY 1, 2) ON true""")
def diag_report(spark, sf_dir):
    payload = F.when(F.col("at") % 11 == 0, F.lit("[")).when(F.col("at") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"state":"s'), F.col("at") % 3, F.lit('"}')))
    return status.diagnostic_report(_kv(spark, sf_dir).withColumn("payload", payload), {"blob/": "blob", "job/": "transfer", "package/": "package"}, 600)


@query(f"""WITH {_KV} SELECT record_kind, CAST(least(sum(n), 9223372036854775807) AS BIGINT) AS n, max(oldest) AS oldest FROM
    (SELECT moment AS report, split_part(key, '/', 1) AS record_kind, count(*) AS n, max(revision) AS oldest FROM kv GROUP BY 1, 2) GROUP BY record_kind""")
def report_gauges(spark, sf_dir):
    """Sums over reports, which stop at the largest number, and the greatest age."""
    reports = _kv(spark, sf_dir).groupBy("at", F.split_part("key", F.lit("/"), F.lit(1)).alias("record_kind")).agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("oldest"))
    return reports.groupBy("record_kind").agg(F.least(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long").alias("n"), F.max("oldest").alias("oldest"))


@query("SELECT event_type AS mode, count(*) AS runs, CAST(sum(event_id % 50) AS BIGINT) AS materialized, CAST(sum(event_id % 7) AS BIGINT) AS returned FROM events GROUP BY event_type")
def mode_counters(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("runs"), F.sum(k % 50).alias("materialized"), F.sum(k % 7).alias("returned"))


@query("SELECT event_type, CASE WHEN d <= 10 THEN 10 WHEN d <= 100 THEN 100 WHEN d <= 500 THEN 500 END AS bucket, count(*) AS n FROM (SELECT event_type, event_id % 700 AS d FROM events) GROUP BY 1, 2")
def run_histogram(spark, sf_dir):
    runs = table(spark, sf_dir, "events").withColumn("d", F.col("event_id") % 700)
    return status.run_histogram(runs, ["event_type"], "d", [10, 100, 500])


@query("SELECT user_id % 20 AS replica, CAST(sum(event_id % 5) AS BIGINT) AS pushed, CAST(sum(event_id % 3) AS BIGINT) AS pulled, bool_and(event_type <> 'error') AS completed, string_agg(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END, ',' ORDER BY CASE WHEN event_type <> 'view' THEN event_type END) AS seen FROM events GROUP BY 1")
def result_sum(spark, sf_dir):
    k = F.col("event_id")
    seen = F.array_join(F.array_sort(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type")))), ",")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("replica")).agg(F.sum(k % 5).alias("pushed"), F.sum(k % 3).alias("pulled"), F.bool_and(F.col("event_type") != "error").alias("completed"), seen.alias("seen"))


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'conflict' ELSE 'accepted' END ELSE 'pending' END AS transport, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'unknown' END AS execution FROM orders")
def intent_status(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = derived.text("o", k).alias("id")
    transport = o.filter(k % 2 == 0).select(name, F.when(k % 6 == 0, "conflict").otherwise("accepted").alias("kind"))
    return status.intent_status(o.select(name), transport, o.filter(k % 3 == 0).select(name, F.lit("done").alias("state")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey % 10 DESC, o_orderdate, o_orderkey LIMIT 30")
def priority_queue(spark, sf_dir):
    waiting = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return waiting.orderBy((F.col("o_orderkey") % 10).desc(), "o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@query("SELECT conv_id, max(turn) + 1 AS next_step, bool_or(role = 'assistant') AS answered, CASE WHEN max(turn) >= 3 THEN 'completed' ELSE 'waiting' END AS state FROM conversations GROUP BY conv_id")
def workflow_progress(spark, sf_dir):
    """A workflow's steps in order: where it resumes."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_step"), F.bool_or(F.col("role") == "assistant").alias("answered"))
    return t.withColumn("state", F.when(F.col("next_step") > 3, "completed").otherwise("waiting"))


@query("SELECT c_custkey, c_custkey % 100 < 40 AND c_custkey % 7 <> 0 AS holds FROM customer")
def lease_valid(spark, sf_dir):
    """Whether an execution lease holds: it exists and has not expired (at 60)."""
    k = F.col("c_custkey")
    expires = F.when(k % 7 != 0, F.lit(100) - k % 100)
    return table(spark, sf_dir, "customer").select(k, F.coalesce(expires > 60, F.lit(False)).alias("holds"))
