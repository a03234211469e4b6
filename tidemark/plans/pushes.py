"""Queries over pushed batches and publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import publish, push
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.derived import NOW_MS, sql
from tidemark.sources.tables import table


def _rules():
    k = F.col("pos")
    handler = F.when(k % 47 == 0, F.struct(F.lit("retry-later").alias("kind"), F.lit("busy").alias("error_code")))
    return {"can_write": k % 41 != 0, "validator": F.when(k % 43 == 0, F.lit("too-long")), "handler": handler}


def _evaluated(spark, sf_dir):
    ops = derived.operations(spark, sf_dir)
    return push.evaluate(ops, derived.authority_documents(spark, sf_dir), derived.receipts(ops), derived.authority_feeds(spark, sf_dir), NOW_MS, **_rules())


def _pushed(spark, sf_dir):
    ops = derived.operations(spark, sf_dir)
    return push.push(ops, derived.authority_documents(spark, sf_dir), derived.receipts(ops), derived.authority_feeds(spark, sf_dir), NOW_MS, **_rules())


@query(sql("SELECT scope, pos, operation_id, kind0 AS kind, code0 AS error_code, duplicate FROM evaluated", "evaluated"))
def push_decisions(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("scope", "pos", "operation_id", "kind", "error_code", "duplicate")


@query(sql("SELECT scope, pos, kind, error_code, CAST(version AS BIGINT) AS version, duplicate FROM pushed", "pushed"))
def push_versions(spark, sf_dir):
    return _pushed(spark, sf_dir).select("scope", "pos", "kind", "error_code", "version", "duplicate")


@query(sql("SELECT operation_id, kind, error_code, CAST(version AS BIGINT) AS version FROM pushed WHERE duplicate OR error_code = 'operation-id-reused'", "pushed"))
def push_replay(spark, sf_dir):
    found = _pushed(spark, sf_dir).filter("duplicate or error_code = 'operation-id-reused'")
    return found.select("operation_id", "kind", "error_code", "version")


@query(sql("SELECT scope, grp AS group_id, count(*) AS members, count(*) FILTER (kind = 'accepted') AS accepted, count(*) FILTER (error_code = 'group-aborted') AS aborted FROM pushed WHERE grp IS NOT NULL GROUP BY scope, grp", "pushed"))
def push_groups(spark, sf_dir):
    settled = push.settle_groups(_evaluated(spark, sf_dir)).filter(F.col("group").isNotNull())
    return settled.groupBy("scope", F.col("group").alias("group_id")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("kind") == "accepted").alias("accepted"), F.count_if(F.col("error_code") == "group-aborted").alias("aborted"))


@query("""
    WITH m AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
    g AS (SELECT *, bool_and(flag = 'A') OVER (PARTITION BY l_orderkey) AS every FROM m)
    SELECT l_orderkey, l_linenumber, CASE WHEN flag = 'N' THEN 'conflict' WHEN flag = 'R' THEN 'rejected' WHEN every THEN 'accepted' ELSE 'retry-later' END AS kind FROM g
""")
def push_group_abort(spark, sf_dir):
    """Lines of one order, also of none, are a group. A line without a flag goes with those that have one, if any has."""
    members = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    group = F.coalesce(F.col("l_orderkey").cast("string"), F.lit("none"))
    rows = members.select("l_orderkey", "l_linenumber", "flag", F.lit("s").alias("scope"), F.col("l_linenumber").alias("pos"), group.alias("group"), F.lit(False).alias("duplicate"), F.lit(None).cast("string").alias("error_code"))
    # The operator's window has the same partitions.
    most = F.max("flag").over(Window.partitionBy("scope", "group"))
    kind = F.when(F.col("flag") == "A", "accepted").when(F.col("flag") == "N", "conflict").when(F.col("flag") == "R", "rejected")
    rows = rows.withColumn("kind", kind.when(F.col("flag").isNull() & (most == "A"), "accepted").otherwise("retry-later"))
    return push.settle_groups(rows).select("l_orderkey", "l_linenumber", "kind")


@query(sql("SELECT scope, pos, fingerprint FROM printed", "printed"))
def push_fingerprint(spark, sf_dir):
    return derived.operations(spark, sf_dir).select("scope", "pos", push.fingerprint().alias("fingerprint"))


@query(sql("SELECT operation_id, fingerprint, kind, CAST(version AS BIGINT) AS version, error_code FROM pushed WHERE NOT invalid AND NOT duplicate AND kind <> 'retry-later' AND error_code IS DISTINCT FROM 'operation-id-reused'", "pushed"))
def push_receipts(spark, sf_dir):
    return push.new_receipts(_pushed(spark, sf_dir))


@query(sql("SELECT DISTINCT scope, document_id FROM pushed WHERE kind = 'accepted' AND NOT duplicate", "pushed"))
def push_committed(spark, sf_dir):
    return push.committed(_pushed(spark, sf_dir))


@query(sql("SELECT pos, CASE WHEN h THEN 'rejected' ELSE kind END AS kind, CASE WHEN h THEN 'forbidden' ELSE error_code END AS error_code FROM (SELECT *, kind IN ('accepted', 'conflict') AND pos % 9 = 0 AS h FROM pushed)", "pushed"))
def push_visibility(spark, sf_dir):
    return push.masked(_pushed(spark, sf_dir), F.col("pos") % 9 != 0).select("pos", "kind", "error_code")


@query(sql("""
    , sent AS (SELECT DISTINCT operation_id FROM pushed WHERE operation_id <> '' AND pos % 5 <> 0),
    got AS (SELECT operation_id, count(*) AS n, min(kind) AS kind FROM (SELECT operation_id, kind FROM pushed WHERE pos % 3 <> 0 AND operation_id <> '' UNION ALL SELECT operation_id, kind FROM pushed WHERE pos % 50 = 1 AND operation_id <> '') GROUP BY operation_id)
    SELECT coalesce(s.operation_id, g.operation_id) AS operation_id, CASE WHEN s.operation_id IS NULL THEN 'unknown-outcome' WHEN n > 1 THEN 'repeated-outcome' WHEN n IS NULL THEN 'deferred' ELSE kind END AS state
    FROM sent s FULL JOIN got g ON s.operation_id = g.operation_id""", "pushed"))
def push_correlate(spark, sf_dir):
    done = _pushed(spark, sf_dir).filter("operation_id != ''")
    sent = done.filter("pos % 5 != 0").select("operation_id").distinct()
    return push.correlate(sent, done.filter("pos % 3 != 0").unionByName(done.filter("pos % 50 = 1")))


@query(sql("SELECT kind, duplicate, error_code, count(*) AS n FROM pushed GROUP BY kind, duplicate, error_code", "pushed"))
def push_outcome_counts(spark, sf_dir):
    from tidemark.operators.status import outcome_counts

    return outcome_counts(_pushed(spark, sf_dir))


PUBLISHED = """, rows AS (SELECT 's' || (c_custkey % 4) AS scope, 'c' || c_custkey AS id, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS payload, c_custkey % 10 = {tombstones} AS deleted FROM customer),
    decided AS (SELECT r.*, a.version AS old, CASE WHEN r.deleted AND a.id IS NULL THEN 'none' WHEN r.deleted AND a.deleted THEN 'unchanged' WHEN r.deleted THEN 'deleted'
        WHEN NOT coalesce(a.deleted, false) AND a.payload = r.payload AND a.id IS NOT NULL THEN 'unchanged' ELSE 'written' END AS action FROM rows r LEFT JOIN authority a ON r.scope = a.scope AND r.id = a.id)
    SELECT d.scope, d.id, d.action, CASE WHEN d.action IN ('written', 'deleted') THEN CAST(coalesce(f.head, 0) + sum(CASE WHEN d.action IN ('written', 'deleted') THEN 1 ELSE 0 END) OVER (PARTITION BY d.scope ORDER BY pos) AS BIGINT) ELSE d.old END AS version
    FROM decided d LEFT JOIN feeds f ON d.scope = f.scope"""


def _publish(spark, sf_dir, tombstones):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        derived.text("s", k % 4).alias("scope"), derived.text("c", k).alias("id"), k.alias("pos"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("payload"), (k % 10 == tombstones).alias("deleted")
    )
    return publish.publish(rows, derived.authority_documents(spark, sf_dir), derived.authority_feeds(spark, sf_dir))


@query(sql(PUBLISHED.format(tombstones=-1), "authority", "feeds"))
def publish_upsert(spark, sf_dir):
    return _publish(spark, sf_dir, -1)


@query(sql(PUBLISHED.format(tombstones=3), "authority", "feeds"))
def publish_delete(spark, sf_dir):
    return _publish(spark, sf_dir, 3)


@query(sql("""
    , listed AS (SELECT 's' || (c_custkey % 4) AS scope, 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS payload FROM customer WHERE c_custkey % 5 <> 0), live AS (SELECT * FROM authority WHERE NOT deleted)
    SELECT coalesce(l.scope, a.scope) AS scope, coalesce(l.id, a.id) AS id, CASE WHEN l.id IS NULL THEN 'deleted' WHEN a.id IS NOT NULL AND a.payload IS NOT DISTINCT FROM l.payload THEN 'unchanged' ELSE 'written' END AS action
    FROM listed l FULL JOIN live a ON l.scope = a.scope AND l.id = a.id""", "authority"))
def replace_scope(spark, sf_dir):
    k = F.col("c_custkey")
    listed = table(spark, sf_dir, "customer").filter(k % 5 != 0).select(derived.text("s", k % 4).alias("scope"), derived.text("c", k).alias("id"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("payload"))
    return publish.replace_scope(listed, derived.authority_documents(spark, sf_dir))


@query("SELECT DISTINCT 'p' || p_partkey AS id, scope FROM (SELECT p_partkey, 's' || (p_partkey % 3) AS scope FROM part UNION ALL SELECT p_partkey, 's' || (p_partkey % 5) FROM part UNION ALL SELECT p_partkey, 's' || (p_partkey % 2) FROM part)")
def fanout(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(derived.text("p", k).alias("id"), F.array(derived.text("s", k % 3), derived.text("s", k % 5), derived.text("s", k % 2)).alias("scopes"))
    return publish.fan_out(rows, "scopes")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderkey % 7 = 0 AS poisoned, o_orderkey % 100 AS retry_at, o_orderdate, o_custkey % 5 AS tenant FROM orders) WHERE NOT poisoned AND retry_at <= 60 ORDER BY o_orderdate, tenant, o_orderkey LIMIT 50")
def outbox_drain(spark, sf_dir):
    k = F.col("o_orderkey")
    outbox = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 7 == 0).alias("poisoned"), (k % 100).alias("retry_at"), F.col("o_orderdate").alias("requested_at"), (F.col("o_custkey") % 5).alias("tenant"))
    return publish.drain(outbox, F.lit(60), 50).select(F.col("id").alias("o_orderkey"))


@query(sql("SELECT scope, pos, kind, error_code, CASE WHEN kind0 = 'accepted' AND NOT duplicate AND pos % 3 = 0 THEN upper(payload) ELSE payload END AS payload, CASE WHEN kind = 'rejected' AND NOT duplicate AND pos % 2 = 0 THEN payload END AS argument FROM pushed", "pushed"))
def push_canonical(spark, sf_dir):
    """What a handler stores in place of the payload, and the arguments of refusals."""
    ops, k = derived.operations(spark, sf_dir), F.col("pos")
    rules = _rules() | {"canonical": F.when(k % 3 == 0, F.upper("payload")), "arguments": F.create_map(F.lit("was"), F.when(k % 2 == 0, F.col("payload")))}
    done = push.push(ops, derived.authority_documents(spark, sf_dir), derived.receipts(ops), derived.authority_feeds(spark, sf_dir), NOW_MS, **rules)
    return done.select("scope", "pos", "kind", "error_code", "payload", F.col("arguments")["was"].alias("argument"))
