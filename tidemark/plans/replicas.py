"""Queries over replica records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions.ids import id_order
from tidemark.operators import replica, status
from tidemark.plans.registry import query
from tidemark.sources import derived, device_stores
from tidemark.sources.derived import sql
from tidemark.sources.scratch import stored
from tidemark.sources.tables import table

GENERATION = 2
# Columns by which results are compared.
SHOWN = ("id", "current", "base", "base_version", "is_dirty", "local_revision", "pending_op", "rejection", "observed", "observed_version", "generation", "missing", "conflict", "conflict_version", "group_id")


def shown(df):
    return df.select(*SHOWN)


def show_sql(source: str, **new: str) -> str:
    """SELECT of the shown columns, some replaced."""
    return f"SELECT {', '.join(f'{new[c]} AS {c}' if c in new else c for c in SHOWN)} FROM {source}"


_CASES = """, j AS (SELECT r.*, c.*, r.id IS NULL AS fresh,
        r.id IS NOT NULL AND (c_id IS NULL OR (generation = 2 AND coalesce(greatest(base_version, observed_version) >= c_version, false))) AS ignored FROM records r FULL JOIN changes c ON r.id = c.c_id),
    k AS (SELECT *, NOT fresh AND NOT ignored AND is_dirty AS dirty, NOT fresh AND NOT ignored AND NOT is_dirty AS clean FROM j)"""


def _apply_sql(show_local: bool, pull_only: bool) -> str:
    kept = "(clean AND conflict IS NOT NULL)" if show_local else "false"
    base = "NULL" if pull_only else "c_doc"
    return sql(_CASES + " " + show_sql(
        "k", id="coalesce(id, c_id)", current=f"CASE WHEN {kept} THEN current WHEN fresh OR clean THEN c_doc ELSE current END", base=f"CASE WHEN fresh OR clean THEN {base} ELSE base END",
        base_version="CASE WHEN fresh OR clean THEN c_version ELSE base_version END", is_dirty="coalesce(is_dirty, false)", local_revision="coalesce(local_revision, 0)",
        observed="CASE WHEN dirty THEN c_doc WHEN clean THEN NULL ELSE observed END", observed_version="CASE WHEN dirty THEN c_version WHEN clean THEN NULL ELSE observed_version END",
        generation="CASE WHEN fresh OR dirty OR clean THEN 2 ELSE generation END", missing="CASE WHEN fresh OR dirty OR clean THEN false ELSE missing END", conflict_version=f"CASE WHEN {kept} THEN c_version ELSE conflict_version END",
    ), "records", "changes")


@query(_apply_sql(False, False))
def apply_remote(spark, sf_dir):
    return shown(replica.apply_remote(derived.records(spark, sf_dir), derived.remote_changes(spark, sf_dir), GENERATION))


@query(_apply_sql(True, True))
def apply_remote_pull_only(spark, sf_dir):
    return shown(replica.apply_remote(derived.records(spark, sf_dir), derived.remote_changes(spark, sf_dir), GENERATION, pull_only=True, show_local=True))


_SETTLED = """SELECT * REPLACE (CASE WHEN adopt THEN observed ELSE current END AS current, CASE WHEN adopt THEN observed ELSE base END AS base, CASE WHEN adopt THEN observed_version ELSE base_version END AS base_version,
        CASE WHEN adopt OR stale THEN NULL ELSE observed END AS observed, CASE WHEN adopt OR stale THEN NULL ELSE observed_version END AS observed_version)
    FROM (SELECT *, coalesce(observed_version <= base_version, false) AS stale, observed_version IS NOT NULL AND NOT coalesce(observed_version <= base_version, false) AND NOT is_dirty AS adopt FROM {source})"""


@query(sql(", t AS (" + _SETTLED.format(source="records") + ") " + show_sql("t"), "records"))
def settle(spark, sf_dir):
    return shown(replica.settle(derived.records(spark, sf_dir)))


_ACKED = """, o AS (SELECT 'op' || o_orderkey AS o_id, CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' WHEN o_orderkey % 4 = 2 THEN 'rejected' ELSE 'conflict' END AS o_kind, o_orderkey + 7 AS o_version, 'ok' || o_orderkey AS o_doc,
        CASE WHEN o_orderkey % 12 = 2 THEN 'base-expired' WHEN o_orderkey % 12 = 6 THEN NULL ELSE 'forbidden' END AS o_code FROM orders WHERE o_orderkey % 16 <> 0),
    j AS (SELECT r.*, o.*, coalesce(o_kind = 'accepted', false) AS acc, coalesce(o_kind = 'rejected', false) AS rej, local_revision IS NOT DISTINCT FROM pending_revision AS same FROM records r LEFT JOIN o ON r.pending_op = o.o_id),
    m AS (SELECT * REPLACE (CASE WHEN acc AND same THEN o_doc ELSE current END AS current, CASE WHEN acc THEN o_doc WHEN rej AND o_code = 'base-expired' THEN NULL ELSE base END AS base,
        CASE WHEN acc THEN o_version WHEN rej AND o_code = 'base-expired' THEN NULL ELSE base_version END AS base_version, is_dirty AND NOT (acc AND same) AS is_dirty,
        CASE WHEN acc AND same THEN NULL WHEN rej AND same THEN coalesce(o_code, 'rejected') ELSE rejection END AS rejection, CASE WHEN rej AND o_code = 'base-expired' THEN NULL ELSE observed END AS observed,
        CASE WHEN rej AND o_code = 'base-expired' THEN NULL ELSE observed_version END AS observed_version, CASE WHEN acc THEN 2 ELSE generation END AS generation,
        CASE WHEN acc AND pending_group IS NOT NULL AND group_id = pending_group THEN NULL ELSE group_id END AS group_id, CASE WHEN acc OR rej THEN NULL ELSE pending_op END AS pending_op) FROM j),
    s AS (""" + _SETTLED.format(source="(SELECT * FROM m WHERE acc)") + ") "


@query(sql(_ACKED + show_sql("s") + " UNION ALL " + show_sql("m") + " WHERE NOT acc", "records"))
def ack_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.when(k % 12 == 2, "base-expired").when(k % 12 == 6, F.lit(None)).otherwise("forbidden")
    outcomes = table(spark, sf_dir, "orders").filter(k % 16 != 0).select(
        derived.text("op", k).alias("operation_id"), F.when(k % 4 == 0, "accepted").when(k % 4 == 2, "rejected").otherwise("conflict").alias("kind"), (k + 7).alias("version"), derived.text("ok", k).alias("document"), code.alias("error_code")
    )
    return shown(replica.acknowledge(derived.records(spark, sf_dir), outcomes, GENERATION))


_RESOLVED = """, d AS (SELECT 'op' || o_orderkey AS d_id, CASE (o_orderkey // 2) % 4 WHEN 0 THEN 'use-master' WHEN 1 THEN 'keep-fork' WHEN 2 THEN 'use-resolved' ELSE 'defer' END AS outcome, 'srv' || o_orderkey AS server, o_orderkey + 3 AS d_version,
        'res' || o_orderkey AS resolved, o_orderkey % 5 + 1 + CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END AS d_revision FROM orders),
    j AS (SELECT r.*, d.*, d_id IS NOT NULL AS hit, d_id IS NOT NULL AND local_revision = d_revision AS go, current AS fork FROM records r LEFT JOIN d ON r.pending_op = d.d_id),
    m AS (SELECT * REPLACE (CASE WHEN go AND outcome IN ('use-master', 'defer') THEN server WHEN go AND outcome = 'use-resolved' THEN resolved ELSE current END AS current, CASE WHEN go THEN server ELSE base END AS base,
        CASE WHEN go THEN d_version ELSE base_version END AS base_version, CASE WHEN go THEN outcome IN ('keep-fork', 'use-resolved') ELSE is_dirty END AS is_dirty, local_revision + CASE WHEN go AND outcome = 'use-resolved' THEN 1 ELSE 0 END AS local_revision,
        CASE WHEN go AND outcome IN ('use-master', 'defer') THEN NULL ELSE rejection END AS rejection, CASE WHEN go AND outcome = 'defer' THEN fork ELSE conflict END AS conflict, CASE WHEN go AND outcome = 'defer' THEN d_version ELSE conflict_version END AS conflict_version,
        CASE WHEN go THEN 2 ELSE generation END AS generation, CASE WHEN hit THEN NULL ELSE pending_op END AS pending_op) FROM j),
    s AS (""" + _SETTLED.format(source="m") + ") "


@query(sql(_RESOLVED + show_sql("s"), "records"))
def conflict_resolve(spark, sf_dir):
    k = F.col("o_orderkey")
    step = F.floor(k / 2) % 4
    decisions = table(spark, sf_dir, "orders").select(
        derived.text("op", k).alias("operation_id"), F.when(step == 0, "use-master").when(step == 1, "keep-fork").when(step == 2, "use-resolved").otherwise("defer").alias("outcome"), derived.text("srv", k).alias("server"),
        (k + 3).alias("server_version"), derived.text("res", k).alias("resolved"), (k % 5 + 1 + F.when(k % 14 == 0, 1).otherwise(0)).alias("revision"),
    )
    return shown(replica.resolve(derived.records(spark, sf_dir), decisions, GENERATION))


@query(sql(show_sql("records", missing="missing OR k % 8 = 0", generation="CASE WHEN k % 8 = 0 AND NOT missing THEN 2 ELSE generation END") + " WHERE NOT (k % 8 = 0 AND NOT is_dirty AND conflict IS NULL)", "records"))
def removals_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    removed = table(spark, sf_dir, "orders").filter(k % 8 == 0).select(derived.text("o", k).alias("id"))
    return shown(replica.remove(derived.records(spark, sf_dir), removed, GENERATION))


_STALE = "(NOT is_dirty AND NOT missing AND generation < 2)"


@query(sql(show_sql("records", missing=f"missing OR {_STALE}", generation=f"CASE WHEN {_STALE} THEN 2 ELSE generation END"), "records"))
def resnapshot_sweep(spark, sf_dir):
    return shown(replica.sweep(derived.records(spark, sf_dir), GENERATION, purge=False))


@query(sql(show_sql("records", missing=f"missing OR {_STALE}", generation=f"CASE WHEN {_STALE} THEN 2 ELSE generation END") + f" WHERE NOT ({_STALE} AND conflict IS NULL)", "records"))
def resnapshot_purge(spark, sf_dir):
    return shown(replica.sweep(derived.records(spark, sf_dir), GENERATION, purge=True))


@query(sql(show_sql("records") + " WHERE NOT coalesce(k % 2 = 0 AND NOT is_dirty AND conflict IS NULL AND base_version <= 5000 AND generation = 2, false)", "records"))
def compaction(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    return shown(replica.compact(records, F.substring("id", 2, 20).cast("long") % 2 == 0, 5000, GENERATION))


@query("SELECT o_orderkey AS replica, NULL::VARCHAR AS checkpoint, o_orderkey % 5 + 1 AS generation, true AS resnapshot, o_orderkey % 3 <> 0 AS purge_missing FROM orders")
def reset_cursor(spark, sf_dir):
    k = F.col("o_orderkey")
    cursors = table(spark, sf_dir, "orders").select(k.alias("replica"), F.lit("x").alias("checkpoint"), (k % 5).alias("generation"), F.when(k % 3 == 0, "epoch").when(k % 3 == 1, "expired").otherwise("scope-changed").alias("reason"))
    return replica.reset(cursors, "reason")


_WRITES = """, w AS (SELECT CASE WHEN o_orderkey % 6 = 3 THEN 'new' || o_orderkey ELSE 'o' || o_orderkey END AS w_id, 'w' || o_orderkey AS w_doc, o_orderkey % 9 = 0 AS w_delete, CASE WHEN o_orderkey % 5 = 0 THEN 'wg' || (o_orderkey % 10) END AS w_group FROM orders WHERE o_orderkey % 3 = 0),
    j AS (SELECT r.*, w.*, w_id IS NOT NULL AS hit FROM records r FULL JOIN w ON r.id = w.w_id WHERE r.id IS NOT NULL OR NOT w_delete) """


@query(sql(_WRITES + show_sql("j", id="coalesce(id, w_id)", current="CASE WHEN hit AND NOT w_delete THEN w_doc ELSE current END", is_dirty="hit OR is_dirty", local_revision="coalesce(local_revision, 0) + CASE WHEN hit THEN 1 ELSE 0 END",
    rejection="CASE WHEN NOT hit THEN rejection END", missing="NOT hit AND missing", group_id="CASE WHEN hit THEN w_group ELSE group_id END", generation="coalesce(generation, 0)"), "records"))
def local_write(spark, sf_dir):
    k = F.col("o_orderkey")
    writes = table(spark, sf_dir, "orders").filter(k % 3 == 0).select(
        F.when(k % 6 == 3, derived.text("new", k)).otherwise(derived.text("o", k)).alias("id"), derived.text("w", k).alias("document"), (k % 9 == 0).alias("delete"), F.when(k % 5 == 0, derived.text("wg", k % 10)).alias("group_id")
    )
    return shown(replica.write(derived.records(spark, sf_dir), writes))


def _third():
    return F.substring("id", 2, 20).cast("long") % 3 == 0


_DISCARD = "(k % 3 = 0 AND conflict IS NOT NULL)"


@query(sql(show_sql("records", conflict=f"CASE WHEN NOT {_DISCARD} THEN conflict END", conflict_version=f"CASE WHEN NOT {_DISCARD} THEN conflict_version END", current=f"CASE WHEN {_DISCARD} THEN coalesce(base, current) ELSE current END"), "records"))
def conflict_discard(spark, sf_dir):
    return shown(replica.discard_conflicts(derived.records(spark, sf_dir), _third()))


_RETRY = "(k % 3 = 0 AND rejection IS NOT NULL)"


@query(sql(show_sql("records", is_dirty=f"is_dirty OR {_RETRY}", local_revision=f"local_revision + CASE WHEN {_RETRY} THEN 1 ELSE 0 END", pending_op=f"CASE WHEN NOT {_RETRY} THEN pending_op END", rejection=f"CASE WHEN NOT {_RETRY} THEN rejection END"), "records"))
def rejected_retry(spark, sf_dir):
    return shown(replica.retry(derived.records(spark, sf_dir), _third()))


@query(sql(""", j AS (SELECT *, k % 3 = 0 AND is_dirty AS hit, observed_version IS NOT NULL AND (base_version IS NULL OR observed_version > base_version) AS newer FROM records) """ + show_sql("j",
    current="CASE WHEN hit THEN coalesce(CASE WHEN newer THEN observed ELSE base END, current) ELSE current END", base="CASE WHEN hit AND newer THEN observed ELSE base END", base_version="CASE WHEN hit AND newer THEN observed_version ELSE base_version END",
    is_dirty="is_dirty AND NOT hit", local_revision="local_revision + CASE WHEN hit THEN 1 ELSE 0 END", pending_op="CASE WHEN NOT hit THEN pending_op END", rejection="CASE WHEN NOT hit THEN rejection END",
    observed="CASE WHEN NOT hit THEN observed END", observed_version="CASE WHEN NOT hit THEN observed_version END", missing="CASE WHEN hit THEN (CASE WHEN newer THEN observed ELSE base END) IS NULL ELSE missing END"), "records"))
def local_revert(spark, sf_dir):
    return shown(replica.revert(derived.records(spark, sf_dir), _third()))


@query(sql("SELECT id FROM records WHERE is_dirty AND rejection IS NULL AND k % 7 <> 0 ORDER BY k % 11, id LIMIT 50", "records"))
def pending_queue(spark, sf_dir):
    k = F.substring("id", 2, 20).cast("long")
    return derived.records(spark, sf_dir).filter(replica.pushable() & (k % 7 != 0)).orderBy(k % 11, id_order(F.col("id"))).limit(50).select("id")


@query(sql("SELECT id, conflict FROM records WHERE conflict IS NOT NULL ORDER BY id LIMIT 40", "records"))
def conflicts_list(spark, sf_dir):
    return derived.records(spark, sf_dir).filter("conflict is not null").orderBy(id_order(F.col("id"))).limit(40).select("id", "conflict")


@query(sql("SELECT id, rejection FROM records WHERE is_dirty AND rejection IS NOT NULL ORDER BY id LIMIT 40", "records"))
def rejected_list(spark, sf_dir):
    return derived.records(spark, sf_dir).filter("is_dirty and rejection is not null").orderBy(id_order(F.col("id"))).limit(40).select("id", "rejection")


@query(sql(f"SELECT id, generation FROM records WHERE {_STALE} ORDER BY id LIMIT 60", "records"))
def stale_list(spark, sf_dir):
    return derived.records(spark, sf_dir).filter("not is_dirty and not missing and generation < 2").orderBy(id_order(F.col("id"))).limit(60).select("id", "generation")


@query(sql("SELECT id, current FROM records WHERE NOT missing AND id > 'o2' ORDER BY id LIMIT 70", "records"))
def visible_page(spark, sf_dir):
    found = derived.records(spark, sf_dir).filter(~F.col("missing") & (id_order(F.col("id")) > id_order(F.lit("o2"))))
    return found.orderBy(id_order(F.col("id"))).limit(70).select("id", "current")


@query(sql("SELECT id, rejection, conflict FROM records WHERE (is_dirty AND rejection IS NULL) OR (is_dirty AND rejection IS NOT NULL) OR conflict IS NOT NULL", "records"))
def export_changes(spark, sf_dir):
    return replica.export_changes(derived.records(spark, sf_dir)).select("id", "rejection", "conflict")


_EXPORTED = "(is_dirty OR conflict IS NOT NULL)"


@query(sql(f"SELECT id FROM records WHERE {_EXPORTED} AND k % 2 = 0", "records"))
def import_skipped(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    exported = replica.export_changes(records).filter(F.substring("id", 2, 20).cast("long") % 2 == 0)
    return replica.import_changes(records, exported, GENERATION)[1]


@query(sql(f"SELECT id, least(generation, 1) AS generation, false AS missing FROM records WHERE {_EXPORTED} UNION ALL SELECT id, generation, missing FROM records WHERE NOT {_EXPORTED}", "records"))
def import_changes(spark, sf_dir):
    """Local work moves to a rebuilt store, which has the clean records only."""
    records = derived.records(spark, sf_dir)
    clean = records.filter("not is_dirty and conflict is null")
    return replica.import_changes(clean, replica.export_changes(records), 1)[0].select("id", "generation", "missing")


@query(sql("""SELECT id, group_id, group_size, pending_op IS NULL OR pending_group IS DISTINCT FROM group_id OR CASE WHEN group_id IS NULL THEN 0 ELSE 2 END <> group_size AS renew
    FROM (SELECT *, CASE WHEN group_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY group_id) END AS group_size, bool_and(is_dirty AND rejection IS NULL) OVER (PARTITION BY group_id) AS whole FROM records) WHERE is_dirty AND rejection IS NULL AND (group_id IS NULL OR whole)""", "records"))
def push_prepare(spark, sf_dir):
    """Pending operations were made for groups of two; a group with a rejected member isn't sent."""
    return replica.prepare(derived.records(spark, sf_dir), F.lit(True), F.when(F.col("group_id").isNotNull(), 2).otherwise(0))


@query(sql("SELECT id, CASE WHEN group_id IS NULL THEN k % 7 = 0 ELSE bool_or(k % 7 = 0) OVER (PARTITION BY group_id) END AS held FROM records WHERE is_dirty AND rejection IS NULL", "records"))
def group_hold_back(spark, sf_dir):
    ready = F.substring("id", 2, 20).cast("long") % 7 != 0
    return replica.held_back(derived.records(spark, sf_dir), ready).select("id", "held")


@query(sql("SELECT id, CASE WHEN is_dirty AND rejection IS NULL AND group_id IN (SELECT group_id FROM records WHERE rejection = 'invalid') THEN 'group-failed' ELSE rejection END AS rejection FROM records", "records"))
def group_park(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    return replica.park(records, records.filter("rejection = 'invalid' and group_id is not null").select("group_id")).select("id", "rejection")


NOW = 900_000


@query(sql(f""", marked AS (SELECT *, coalesce(CASE WHEN group_id IS NULL THEN rejection = 'clock-skew' ELSE bool_or(rejection = 'clock-skew') OVER (PARTITION BY group_id) END AND rejection IN ('clock-skew', 'group-failed'), false) AS s FROM records),
    placed AS (SELECT id, row_number() OVER (ORDER BY k) - 1 AS place FROM marked WHERE s),
    ticked AS (SELECT id, place, greatest((SELECT max(k * 100 * 1000000 + k % 7) FROM marked WHERE NOT s AND k * 100 <= {NOW} + 300000) + 1, {NOW}::BIGINT * 1000000) + place AS t FROM placed)
    SELECT id, place, lpad(CAST(t // 1000000 AS VARCHAR), 15, '0') || ':' || lpad(CAST(t % 1000000 AS VARCHAR), 6, '0') || ':me' AS stamp FROM ticked""", "records"))
def skew_restamp(spark, sf_dir):
    records, k = derived.records(spark, sf_dir), F.substring("id", 2, 20).cast("long")
    stamped = records.withColumn("updated_at", clock.encode(k * 100, k % 7, F.lit("n")))
    return replica.restamp(stamped, "me", NOW)


@query("""
    WITH RECURSIVE u AS (SELECT doc_id // 500 AS request, doc_id AS pos, strlen(text) AS bytes, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS i FROM documents),
    ps AS (SELECT request, i, sum(bytes) OVER (PARTITION BY request ORDER BY i) AS s FROM u),
    spans(request, low, high) AS (SELECT request, CAST(0 AS BIGINT), count(*) FROM u GROUP BY request UNION ALL
        SELECT s.request, CASE WHEN side = 0 THEN low ELSE low + (high - low) // 2 END, CASE WHEN side = 0 THEN low + (high - low) // 2 ELSE high END
        FROM spans s JOIN ps e ON e.request = s.request AND e.i = s.high - 1 LEFT JOIN ps b ON b.request = s.request AND b.i = s.low - 1, (VALUES (0), (1)) t(side) WHERE high - low > 1 AND e.s - coalesce(b.s, 0) > 65536),
    leaves AS (SELECT s.request, s.low, s.high FROM spans s JOIN ps e ON e.request = s.request AND e.i = s.high - 1 LEFT JOIN ps b ON b.request = s.request AND b.i = s.low - 1 WHERE high - low = 1 OR e.s - coalesce(b.s, 0) <= 65536)
    SELECT u.request, u.pos, low AS batch_from, high AS batch_to, high - low = 1 AND bytes > 65536 AS too_large FROM u JOIN leaves l ON l.request = u.request AND u.i >= l.low AND u.i < l.high
""")
def batch_split(spark, sf_dir):
    """All documents as requests of up to 500 units."""
    k = F.col("doc_id")
    units = table(spark, sf_dir, "documents").select(F.floor(k / 500).cast("long").alias("request"), k.alias("pos"), F.octet_length("text").cast("long").alias("bytes"))
    return replica.batches(units, 65_536, ["request"]).drop("bytes")


@query(sql("SELECT id, CASE WHEN missing THEN 'missing-after-reset' WHEN conflict IS NOT NULL THEN 'conflicted' WHEN rejection IS NOT NULL THEN 'rejected' WHEN is_dirty THEN 'pending' ELSE 'synced' END AS state FROM records", "records"))
def item_status(spark, sf_dir):
    return derived.records(spark, sf_dir).select("id", status.item_state().alias("state"))


@query(sql("SELECT count(*) FILTER (is_dirty) AS dirty, count(*) FILTER (conflict IS NOT NULL) AS conflicts, count(*) FILTER (is_dirty AND rejection IS NOT NULL AND rejection <> 'group-failed') AS rejected, count(*) FILTER (is_dirty AND rejection = 'group-failed') AS blocked FROM records", "records"))
def issue_counts(spark, sf_dir):
    return status.issue_counts(derived.records(spark, sf_dir))


def _issues_sql(limit: int, offset: int) -> str:
    return sql(f""", i AS (SELECT 0 AS part, id, 'conflict' AS kind FROM records WHERE conflict IS NOT NULL UNION ALL SELECT 1, id, CASE WHEN rejection = 'group-failed' THEN 'blocked' ELSE 'rejected' END FROM records WHERE is_dirty AND rejection IS NOT NULL),
        page AS (SELECT id, kind FROM i ORDER BY part, id LIMIT {limit} OFFSET {offset}) SELECT id, kind, total FROM (SELECT count(*) AS total FROM i) LEFT JOIN page ON true""", "records")


@query(_issues_sql(100, 40))
def issue_page(spark, sf_dir):
    return status.issues(derived.records(spark, sf_dir), id_order(F.col("id")), 40, 100)


@query(_issues_sql(100, 10**6))
def issue_page_beyond(spark, sf_dir):
    return status.issues(derived.records(spark, sf_dir), id_order(F.col("id")), 10**6, 100)


@query(sql("SELECT k AS n, id, CASE WHEN k % 5 = 0 THEN current WHEN k % 2 = 0 THEN 'upd' || k ELSE current END AS current, k % 5 <> 0 AND k % 2 = 0 AS changed FROM records UNION ALL SELECT o_orderkey, 'add' || o_orderkey, 'upd' || o_orderkey, true FROM orders WHERE o_orderkey % 37 = 0", "records"))
def record_update(spark, sf_dir):
    """Updates of known and new records; one in five decides to leave the record as it is."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    records = derived.records(spark, sf_dir).select("id", "current", F.substring("id", 2, 20).cast("long").alias("n"))
    known = orders.filter((k % 2 == 0) | (k % 5 == 0)).select(derived.text("o", k).alias("id"), (k % 5 == 0).alias("keep"), derived.text("upd", k).alias("current"), k.alias("n"))
    added = orders.filter(k % 37 == 0).select(derived.text("add", k).alias("id"), F.lit(False).alias("keep"), derived.text("upd", k).alias("current"), k.alias("n"))
    return replica.updated(records, known.unionByName(added), F.col("keep"))


@query(sql(show_sql("records") + f" WHERE {_EXPORTED}", "records"))
def salvage(spark, sf_dir):
    """What a rebuilt store takes over from a damaged one."""
    return shown(derived.records(spark, sf_dir).filter(F.col("is_dirty") | F.col("conflict").isNotNull()))


_HELD = "(rejection = 'group-failed' AND group_id IN (SELECT group_id FROM records WHERE k % 60 = 0 AND group_id IS NOT NULL))"


@query(sql(f"SELECT id, CASE WHEN {_HELD} THEN NULL ELSE rejection END AS rejection, CASE WHEN {_HELD} THEN NULL ELSE pending_op END AS pending_op FROM records", "records"))
def group_release(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    groups = records.filter((F.substring("id", 2, 20).cast("long") % 60 == 0) & F.col("group_id").isNotNull()).select("group_id")
    return replica.release(records, groups).select("id", "rejection", "pending_op")


_SETTLED_BY_USER = "(k % 4 = 1 AND conflict IS NOT NULL)"


@query(sql(show_sql("records", current=f"CASE WHEN {_SETTLED_BY_USER} THEN 'res' || k ELSE current END", is_dirty=f"is_dirty OR {_SETTLED_BY_USER}", local_revision=f"local_revision + CASE WHEN {_SETTLED_BY_USER} THEN 1 ELSE 0 END",
    rejection=f"CASE WHEN NOT {_SETTLED_BY_USER} THEN rejection END", conflict=f"CASE WHEN NOT {_SETTLED_BY_USER} THEN conflict END", conflict_version=f"CASE WHEN NOT {_SETTLED_BY_USER} THEN conflict_version END", missing=f"missing AND NOT {_SETTLED_BY_USER}"), "records"))
def conflict_resolve_kept(spark, sf_dir):
    k = F.col("o_orderkey")
    resolved = table(spark, sf_dir, "orders").filter(k % 4 == 1).select(derived.text("o", k).alias("id"), derived.text("res", k).alias("document"))
    return shown(replica.resolve_kept(derived.records(spark, sf_dir), resolved))


_DEVICES = "dev AS (SELECT *, 'd' || (k // 2000) AS device FROM records)"


def _device_stores(spark, sf_dir):
    """The records as stores of devices with 2000 keys each, of which the second's are of a newer schema and the third's cut off."""
    r = derived.records(spark, sf_dir)
    k = F.substring("id", 2, 20).cast("long")
    made = device_stores.to_device_stores(r.withColumns({"device": derived.text("d", F.floor(k / 2000)), "kind": F.lit("orders")}), "device", "kind", 150)
    newer = F.concat(F.substring("content", 1, 60), F.lit(bytearray(b"\0\0\0\7")), F.expr("substring(content, 65)"))
    content = F.when(F.col("device") == "d1", newer).when(F.col("device") == "d2", F.substring("content", 1, 5000)).otherwise(F.col("content"))
    return stored(made.select(F.concat_ws("/", "device", "part").alias("path"), content.alias("content"), F.col("n").alias("_n")), "device-stores")


@query(sql(f", {_DEVICES} SELECT device, {', '.join(replica.COLUMNS)} FROM dev WHERE device NOT IN ('d1', 'd2')", "records"))
def device_store_records(spark, sf_dir):
    found = device_stores.device_records(_device_stores(spark, sf_dir))
    return found.select(F.substring_index("path", "/", 1).alias("device"), *replica.COLUMNS)


@query(sql(f", {_DEVICES} SELECT device, CASE device WHEN 'd1' THEN 'newer' WHEN 'd2' THEN 'unreadable' ELSE 'ok' END AS state, CASE WHEN device NOT IN ('d1', 'd2') THEN count(*) END AS n FROM dev GROUP BY device", "records"))
def device_store_states(spark, sf_dir):
    found = device_stores.device_states(_device_stores(spark, sf_dir))
    return found.groupBy(F.substring_index("path", "/", 1).alias("device")).agg(F.max("state").alias("state"), F.sum("n").alias("n"))
