"""Queries over the change feed and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import checkpoint
from tidemark.operators import feed, membership
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.derived import sql
from tidemark.sources.tables import table


@query(sql("SELECT scope, id, version, deleted, updated_at FROM docs", "docs"))
def feed_latest(spark, sf_dir):
    return derived.documents(spark, sf_dir).select("scope", "id", "version", "deleted", "updated_at")


def _page(since: int, limit: int, readable: str = "true", source: str = "docs WHERE scope = 's1'") -> str:
    return sql(f""", page AS (SELECT *, row_number() OVER (ORDER BY version) AS n FROM {source} AND version > {since} ORDER BY version LIMIT {limit + 1}),
        facts AS (SELECT count(*) > {limit} AS has_more, coalesce(max(version) FILTER (n <= {limit}), {since})::BIGINT AS checkpoint FROM page)
        SELECT id, version, deleted, has_more, checkpoint FROM facts LEFT JOIN page ON n <= {limit} AND ({readable})""", "docs")


def _pulled(spark, sf_dir, since, limit, can_read=None):
    docs = derived.documents(spark, sf_dir).filter("scope = 's1'").select("id", "version", "deleted", "event_type")
    return feed.pull_page(docs, since, limit, can_read).select("id", "version", "deleted", "has_more", "checkpoint")


@query(_page(100, 20))
def feed_pull_page(spark, sf_dir):
    return _pulled(spark, sf_dir, 100, 20)


@query(_page(100, 20, "event_type <> 'view'"))
def feed_can_read_after_limit(spark, sf_dir):
    return _pulled(spark, sf_dir, 100, 20, F.col("event_type") != "view")


@query(_page(10**9, 20))
def feed_pull_at_the_head(spark, sf_dir):
    """A page without rows still says where the caller stands."""
    return _pulled(spark, sf_dir, 10**9, 20)


@query(_page(0, 10, "event_type = 'none'"))
def feed_pull_unreadable(spark, sf_dir):
    """A page of which nothing may be read still advances the caller."""
    return _pulled(spark, sf_dir, 0, 10, F.col("event_type") == "none")


@query(sql("SELECT scope, id, version, CAST((row_number() OVER (PARTITION BY scope ORDER BY version) - 1) // 50 AS BIGINT) AS page FROM changelog", "changelog"))
def feed_pages(spark, sf_dir):
    return feed.pages(derived.changelog(spark, sf_dir), 50).select("scope", "id", "version", "page")


@query(sql("SELECT scope, max(version) AS head FROM changelog GROUP BY scope", "changelog"))
def feed_heads(spark, sf_dir):
    return feed.heads(derived.changelog(spark, sf_dir))


@query(sql("SELECT scope, id, version FROM docs WHERE NOT deleted", "docs"))
def feed_snapshot(spark, sf_dir):
    return feed.snapshot(derived.documents(spark, sf_dir)).select("scope", "id", "version")


@query("""
    WITH c AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nonsense' WHEN 2 THEN 'e1:' || event_id WHEN 3 THEN 'e0~h:' || event_id WHEN 4 THEN 'e1~x:' || event_id
        WHEN 5 THEN 'e1~' || substr(upper(sha256('view')), 1, 16) || ':' || event_id ELSE 'e1~' || substr(upper(sha256('view')), 1, 16) || ':0' || event_id END AS checkpoint FROM events)
    SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'epoch' WHEN 3 THEN 'epoch' WHEN 4 THEN 'scope-changed' WHEN 5 THEN CASE WHEN event_id > 0 AND event_id < 5000 THEN 'expired' END WHEN 6 THEN 'malformed' END AS reason FROM c
""")
def feed_checkpoint_reasons(spark, sf_dir):
    k = F.col("event_id")
    view = checkpoint.scope_hash(F.lit("view"))
    at = (
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, "nonsense").when(k % 7 == 2, F.concat(F.lit("e1:"), k)).when(k % 7 == 3, checkpoint.encode(F.lit("e0"), F.lit("h"), k))
        .when(k % 7 == 4, checkpoint.encode(F.lit("e1"), F.lit("x"), k)).when(k % 7 == 5, checkpoint.encode(F.lit("e1"), view, k)).otherwise(F.concat(F.lit("e1~"), view, F.lit(":0"), k))
    )
    reason = checkpoint.reset_reason(F.col("at"), F.lit("e1"), view, F.lit(5000))
    return table(spark, sf_dir, "events").select("event_id", at.alias("at")).select("event_id", reason.alias("reason"))


@query("""
    WITH sent AS (SELECT event_id // 20 AS page, CASE WHEN event_id % 500 = 7 THEN '' ELSE 'u' || (CASE WHEN (event_id // 20) % 3 = 0 THEN user_id ELSE event_id END) END AS id,
        event_id - CASE WHEN (event_id // 20) % 11 = 0 THEN 221 ELSE 0 END AS version FROM events WHERE event_id % 20 < 19 OR (event_id // 20) % 7 = 0),
    gone AS (SELECT event_id // 20 AS page, 'u' || event_id AS id FROM events WHERE event_id % 160 = 42
        UNION ALL SELECT event_id // 20 + CASE WHEN event_id % 260 = 13 THEN 0 ELSE 1000000 END, 'x' || CASE WHEN event_id % 520 = 13 THEN '' || event_id % 3 ELSE chr(1 + CAST(event_id % 40 AS INTEGER)) END FROM events WHERE event_id % 130 = 13
        UNION ALL SELECT event_id // 20 + 1000000, 'y' FROM events WHERE event_id % 390 = 13 UNION ALL SELECT event_id // 20 + 1000000, 'y' FROM events WHERE event_id % 780 = 13),
    headers AS (SELECT DISTINCT event_id // 20 AS page, true AS more, 'c' || (event_id // 20) AS since, 'c' || (event_id // 20 + CASE WHEN (event_id // 20) % 10 = 9 THEN 0 ELSE 1 END) AS checkpoint FROM events
        UNION ALL SELECT DISTINCT page, false, 'c', 'c' FROM gone WHERE page >= 1000000),
    changed AS (SELECT page, count(*) AS n, count(DISTINCT id) AS ids, bool_or(NOT (length(id) BETWEEN 1 AND 256 AND NOT regexp_matches(id, '[\\x00-\\x1F]'))) AS bad, min(version) < 1 AS low FROM sent GROUP BY page),
    removed AS (SELECT g.page, count(*) AS n, count(DISTINCT g.id) AS ids, bool_or(NOT (length(g.id) BETWEEN 1 AND 256 AND NOT regexp_matches(g.id, '[\\x00-\\x1F]'))) AS bad, count(DISTINCT s.id) AS both FROM gone g LEFT JOIN (SELECT DISTINCT page, id FROM sent) s ON g.page = s.page AND g.id = s.id GROUP BY g.page)
    SELECT h.page, CASE WHEN c.n > 19 THEN 'too-many' WHEN more AND since = checkpoint THEN 'no-progress' WHEN c.bad THEN 'invalid-id' WHEN c.low THEN 'invalid-version' WHEN c.n > c.ids THEN 'duplicate-id' WHEN r.bad THEN 'invalid-removal'
        WHEN r.both > 0 THEN 'changed-and-removed' WHEN r.n > r.ids THEN 'repeated-removal' WHEN coalesce(c.ids, 0) + coalesce(r.ids, 0) > 19 THEN 'too-many' END AS fault
    FROM headers h LEFT JOIN changed c ON h.page = c.page LEFT JOIN removed r ON h.page = r.page
""")
def feed_page_faults(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    page = F.floor(k / 20).cast("long")
    name = F.when(k % 500 == 7, F.lit("")).otherwise(derived.text("u", F.when(page % 3 == 0, F.col("user_id")).otherwise(k)))
    sent = e.filter((k % 20 < 19) | (page % 7 == 0)).select(page.alias("page"), name.alias("id"), (k - F.when(page % 11 == 0, 221).otherwise(0)).alias("version"))
    alone = page + 1_000_000  # pages of removals alone
    odd = F.concat(F.lit("x"), F.when(k % 520 == 13, (k % 3).cast("string")).otherwise(F.char(1 + k % 40)))
    gone = (
        e.filter(k % 160 == 42).select(page.alias("page"), derived.text("u", k).alias("id"))
        .unionByName(e.filter(k % 130 == 13).select(F.when(k % 260 == 13, page).otherwise(alone).alias("page"), odd.alias("id")))
        .unionByName(e.filter(k % 390 == 13).select(alone.alias("page"), F.lit("y").alias("id"))).unionByName(e.filter(k % 780 == 13).select(alone.alias("page"), F.lit("y").alias("id")))
    )
    own = e.select(page.alias("page")).distinct().select("page", F.lit(True).alias("has_more"), F.concat(F.lit("c"), "page").alias("since"), F.concat(F.lit("c"), F.col("page") + F.when(F.col("page") % 10 == 9, 0).otherwise(1)).alias("checkpoint"))
    headers = own.unionByName(gone.filter("page >= 1000000").select("page").distinct().select("page", F.lit(False).alias("has_more"), F.lit("c").alias("since"), F.lit("c").alias("checkpoint")))
    return feed.page_faults(headers, sent, gone, "page", 19)


SAMPLES = ", samples AS (SELECT s.scope, d.day, max(s.version) AS head FROM (SELECT 's' || (user_id % 4) AS scope, event_id + 1 AS version, CAST(ts AS DATE) AS day FROM events) s JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d ON s.day = d.day GROUP BY 1, 2)"
CUTOFF = "(SELECT CAST(max(ts) AS DATE) - 10 FROM events)"


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(derived.text("s", F.col("user_id") % 4).alias("scope"), F.to_date("ts").alias("at")).agg(F.max(F.col("event_id") + 1).alias("head"))


def _horizons(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.date_sub(F.to_date(F.max("ts")), 10).alias("cutoff"))
    return feed.horizon_as_of(_samples(spark, sf_dir).join(F.broadcast(last)), F.col("cutoff"), ["scope"])  # one row


@query("WITH" + SAMPLES.lstrip(",") + f" SELECT scope, arg_max(head, day) AS horizon FROM samples WHERE day <= {CUTOFF} GROUP BY scope")
def retention_horizon(spark, sf_dir):
    return _horizons(spark, sf_dir)


@query(sql(SAMPLES + f", h AS (SELECT scope, arg_max(head, day) AS horizon FROM samples WHERE day <= {CUTOFF} GROUP BY scope) SELECT d.scope, d.id, d.version, d.deleted FROM docs d LEFT JOIN h ON d.scope = h.scope WHERE NOT (d.deleted AND d.version <= coalesce(h.horizon, 0))", "docs"))
def purge_tombstones(spark, sf_dir):
    return feed.purge_tombstones(derived.documents(spark, sf_dir), _horizons(spark, sf_dir)).select("scope", "id", "version", "deleted")


@query(sql("SELECT r_id AS operation_id, r_kind AS kind, r_version AS version FROM receipts WHERE NOT (r_kind = 'accepted' AND r_version <= 2000)", "receipts"))
def purge_receipts(spark, sf_dir):
    return feed.purge_receipts(derived.receipts(derived.operations(spark, sf_dir)), F.lit(2000)).select("operation_id", "kind", "version")


@query(sql("SELECT coalesce(a.scope, b.scope) AS scope, greatest(a.head, b.head) AS head FROM (SELECT scope, max(version) AS head FROM changelog WHERE version % 2 = 0 GROUP BY scope) a FULL JOIN (SELECT scope, max(version) AS head FROM changelog WHERE deleted GROUP BY scope) b ON a.scope = b.scope", "changelog"))
def restored_heads(spark, sf_dir):
    c = derived.changelog(spark, sf_dir)
    return feed.restored_heads(feed.heads(c.filter("version % 2 = 0")), feed.heads(c.filter("deleted")))


@query("""
    WITH s AS (SELECT conv_id, turn, turn // 2 AS checkpoint FROM conversations),
    l AS (SELECT *, lag(checkpoint) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM s)
    SELECT conv_id, turn, checkpoint FROM l WHERE n = 1 OR checkpoint IS DISTINCT FROM before
""")
def audit_dedupe(spark, sf_dir):
    samples = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("checkpoint"))
    return feed.audit_history(samples, ["conv_id"], "turn", "checkpoint")


@query(sql("SELECT id, version FROM docs WHERE scope = 's1' AND NOT deleted AND id > 'u2' ORDER BY id LIMIT 25", "docs"))
def list_after(spark, sf_dir):
    return feed.list_page(derived.documents(spark, sf_dir).filter("scope = 's1'"), F.lit("u2"), 25).select("id", "version")


ACCESS = """, w AS (SELECT 's' || (user_id % 4) AS scope, 'u' || user_id AS id, event_id + 1 AS version, event_type = 'error' AS deleted,
        CASE WHEN event_id % 3 = event_id % 5 THEN ['p' || (event_id % 3)] ELSE ['p' || (event_id % 3), 'p' || (event_id % 5)] END AS readers FROM events),
    live AS (SELECT *, sum(CASE WHEN deleted THEN 0 ELSE 1 END) OVER (PARTITION BY scope, id ORDER BY version) AS epoch FROM w),
    now_ AS (SELECT l.scope, l.id, l.version, coalesce(o.readers, []) AS readers FROM live l LEFT JOIN live o ON l.scope = o.scope AND l.id = o.id AND l.epoch = o.epoch AND NOT o.deleted),
    before_ AS (SELECT *, coalesce(lag(readers) OVER (PARTITION BY scope, id ORDER BY version), []) AS prior FROM now_),
    grants AS (SELECT scope, id, version, unnest(readers) AS principal, true AS granted FROM before_
        UNION ALL SELECT scope, id, version, p AS principal, false FROM (SELECT scope, id, version, readers, unnest(prior) AS p FROM before_) x WHERE NOT list_contains(readers, p)),
    access AS (SELECT principal, scope, id, max(version) AS version, arg_max(granted, version) AS granted FROM grants GROUP BY principal, scope, id)"""


def _access(spark, sf_dir):
    return membership.access_rows(derived.writes(spark, sf_dir), ["scope", "id"])


@query("WITH" + ACCESS.lstrip(",") + " SELECT principal, scope, id, version, granted FROM access")
def membership_access(spark, sf_dir):
    return _access(spark, sf_dir).select("principal", "scope", "id", "version", "granted")


def _page_sql(principal: str, since: int, limit: int, removal: str, readable: str = "true") -> str:
    return sql(ACCESS + f""", mine AS (SELECT *, row_number() OVER (ORDER BY version) AS n FROM access WHERE principal = '{principal}' AND scope = 's1' AND version > {since} ORDER BY version LIMIT {limit + 1}),
        facts AS (SELECT count(*) > {limit} AS has_more, coalesce(max(version) FILTER (n <= {limit}), {since})::BIGINT AS checkpoint FROM mine),
        found AS (SELECT m.id, m.version, CASE WHEN m.granted THEN 'change' ELSE '{removal}' END AS kind, d.updated_at FROM mine m LEFT JOIN docs d ON m.granted AND m.scope = d.scope AND m.id = d.id
            WHERE n <= {limit} AND CASE WHEN m.granted THEN {readable} ELSE {since} > 0 END)
        SELECT id, version, kind, updated_at, has_more, checkpoint FROM facts LEFT JOIN found ON true""", "docs")


def _membership_page(spark, sf_dir, principal, since, limit, removals=True, can_read=None):
    access, docs = _access(spark, sf_dir).filter("scope = 's1'"), derived.documents(spark, sf_dir)
    page = membership.membership_page(access, docs, principal, since, limit, ["scope", "id"], removals, can_read)
    return page.select("id", "version", "kind", "updated_at", "has_more", "checkpoint")


@query(_page_sql("p1", 10**9, 5, "removal"))
def membership_pull_at_the_head(spark, sf_dir):
    return _membership_page(spark, sf_dir, "p1", 10**9, 5)


@query(_page_sql("p1", 0, 5, "removal", "d.event_type = 'none'"))
def membership_pull_unreadable(spark, sf_dir):
    return _membership_page(spark, sf_dir, "p1", 0, 5, can_read=F.col("event_type") == "none")


@query(_page_sql("p1", 0, 100, "removal"))
def membership_pull(spark, sf_dir):
    return _membership_page(spark, sf_dir, "p1", 0, 100)


@query(_page_sql("p2", 50, 500, "removal"))
def membership_removals(spark, sf_dir):
    return _membership_page(spark, sf_dir, "p2", 50, 500)


@query(_page_sql("p2", 50, 500, "scope-changed"))
def membership_without_removals(spark, sf_dir):
    return _membership_page(spark, sf_dir, "p2", 50, 500, removals=False)


@query(sql(ACCESS + " SELECT d.scope, d.id, d.version FROM docs d WHERE EXISTS (SELECT 1 FROM access a WHERE a.scope = d.scope AND a.id = d.id AND a.principal = 'p3' AND a.granted)", "docs"))
def membership_readable(spark, sf_dir):
    return membership.readable(derived.documents(spark, sf_dir), _access(spark, sf_dir), "p3", ["scope", "id"]).select("scope", "id", "version")


@query(sql(ACCESS + " SELECT principal, scope, id FROM access a WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.scope = a.scope AND d.id = a.id AND d.version % 3 <> 0)", "docs"))
def membership_orphans(spark, sf_dir):
    kept = derived.documents(spark, sf_dir).filter("version % 3 <> 0")
    return membership.orphaned(_access(spark, sf_dir), kept, ["scope", "id"]).select("principal", "scope", "id")


@query(sql(ACCESS + " SELECT d.scope, d.id, r.readers FROM docs d LEFT JOIN (SELECT scope, id, string_agg(principal, ',' ORDER BY principal) AS readers FROM access WHERE granted GROUP BY scope, id) r ON d.scope = r.scope AND d.id = r.id", "docs"))
def membership_audiences(spark, sf_dir):
    found = membership.audiences(derived.documents(spark, sf_dir), _access(spark, sf_dir), ["scope", "id"])
    return found.select("scope", "id", F.array_join("readers", ",").alias("readers"))


@query(sql("SELECT 'a' AS part, id, version FROM (SELECT * FROM docs WHERE scope = 's1' AND version > 100 ORDER BY version LIMIT 10) UNION ALL SELECT 'b', id, version FROM (SELECT * FROM docs WHERE scope = 's2' AND version > 300 ORDER BY version LIMIT 15)", "docs"))
def batch_pull(spark, sf_dir):
    docs = derived.documents(spark, sf_dir)
    parts = [feed.pull_page(docs.filter(F.col("scope") == s), since, n).select(F.lit(p).alias("part"), "id", "version") for p, s, since, n in (("a", "s1", 100, 10), ("b", "s2", 300, 15))]
    return parts[0].unionByName(parts[1])


@query("WITH r AS (SELECT event_id, event_type, epoch_us(ts) // 60000000 AS slot FROM events) SELECT event_id, event_type, slot, row_number() OVER (PARTITION BY slot, event_type ORDER BY event_id) = 1 AS served FROM r")
def batch_coalesce(spark, sf_dir):
    """In each window the first request per collection is served with the batch, the others wait."""
    from pyspark.sql import Window

    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    requests = table(spark, sf_dir, "events").select("event_id", "event_type", slot.alias("slot"))
    return requests.withColumn("served", F.row_number().over(Window.partitionBy("slot", "event_type").orderBy("event_id")) == 1)


@query(sql(ACCESS + " SELECT d.scope, d.id, d.version, d.deleted FROM docs d JOIN access a ON a.scope = d.scope AND a.id = d.id WHERE a.principal = 'p1' AND a.granted AND d.id IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8', 'u9') AND d.value > 0.2", "docs"))
def membership_get(spark, sf_dir):
    ids = [f"u{i}" for i in range(1, 10)]
    return membership.get(derived.documents(spark, sf_dir), _access(spark, sf_dir), "p1", ids, ["scope", "id"], F.col("value") > 0.2).select("scope", "id", "version", "deleted")


@query(sql(ACCESS + " SELECT d.id, d.version FROM docs d JOIN access a ON a.scope = d.scope AND a.id = d.id WHERE a.principal = 'p2' AND a.granted AND NOT d.deleted AND d.id > 'u1' AND d.event_type <> 'click' ORDER BY d.id LIMIT 30", "docs"))
def membership_list(spark, sf_dir):
    return membership.list_readable(derived.documents(spark, sf_dir), _access(spark, sf_dir), "p2", F.lit("u1"), 30, ["scope", "id"], F.col("event_type") != "click").select("id", "version")


# A run of retention on the last day, with horizons of 10 days for tombstones and 15 for receipts; scope s3 was restored to a lower head.
RETENTION = f"""{SAMPLES}{ACCESS},
    today AS (SELECT datediff('day', DATE '1970-01-01', CAST(max(ts) AS DATE)) AS now_ FROM events),
    f AS (SELECT scope, CASE WHEN scope = 's3' THEN max(version) // 3 ELSE max(version) END AS head, CASE WHEN scope = 's2' THEN 10000000 ELSE 7 END AS purged_through FROM changelog GROUP BY scope),
    taken AS (SELECT scope, datediff('day', DATE '1970-01-01', day) AS moment, head FROM samples WHERE datediff('day', DATE '1970-01-01', day) % 2 = 0 UNION ALL SELECT scope, now_, head FROM f, today),
    h AS (SELECT scope, arg_max(head, moment) FILTER (moment <= now_ - 10) AS t, arg_max(head, moment) FILTER (moment <= now_ - 15) AS r, max(moment) FILTER (moment <= now_ - 15) AS since FROM taken, today GROUP BY scope),
    b AS (SELECT f.scope, f.purged_through, f.head, least(h.t, f.head) AS t, h.r, h.since FROM f LEFT JOIN h ON f.scope = h.scope)"""


def _retained(spark, sf_dir, part):
    log, last = derived.changelog(spark, sf_dir), table(spark, sf_dir, "events").agg(F.unix_date(F.to_date(F.max("ts")))).first()[0]
    head = F.max("version")
    feeds_ = log.groupBy("scope").agg(F.when(F.col("scope") == "s3", F.floor(head / 3)).otherwise(head).cast("long").alias("head")).withColumn("purged_through", F.when(F.col("scope") == "s2", 10_000_000).otherwise(7).cast("long"))
    samples = _samples(spark, sf_dir).withColumn("at", F.unix_date("at").cast("long")).filter("at % 2 = 0")
    k = F.col("version")
    receipts = log.select("scope", derived.text("op", k).alias("operation_id"), F.when(k % 3 == 0, "conflict").otherwise("accepted").alias("kind"), k)
    return feed.retention_run(derived.documents(spark, sf_dir), receipts, _access(spark, sf_dir), feeds_, samples, last, 10, 15)[part]


@query(sql(RETENTION + " SELECT d.scope, d.id, d.version, d.deleted FROM docs d LEFT JOIN b ON d.scope = b.scope WHERE NOT coalesce(d.deleted AND d.version <= b.t, false)", "docs"))
def retention_documents(spark, sf_dir):
    return _retained(spark, sf_dir, "documents").select("scope", "id", "version", "deleted")


@query(sql(RETENTION + " SELECT c.scope, 'op' || version AS operation_id FROM changelog c LEFT JOIN b ON c.scope = b.scope WHERE NOT coalesce(version % 3 <> 0 AND version <= b.r, false)", "docs"))
def retention_receipts(spark, sf_dir):
    return _retained(spark, sf_dir, "receipts").select("scope", "operation_id")


@query(sql(RETENTION + " SELECT a.principal, a.scope, a.id FROM access a WHERE NOT EXISTS (SELECT 1 FROM docs d JOIN b ON d.scope = b.scope WHERE d.scope = a.scope AND d.id = a.id AND d.deleted AND d.version <= b.t)", "docs"))
def retention_access(spark, sf_dir):
    return _retained(spark, sf_dir, "access").select("principal", "scope", "id")


@query(sql(RETENTION + " SELECT scope, head, greatest(purged_through, coalesce(t, 0)) AS purged_through FROM b", "docs"))
def retention_feeds(spark, sf_dir):
    return _retained(spark, sf_dir, "feeds")


@query(sql(RETENTION + " SELECT t.scope, t.moment AS \"at\", t.head FROM taken t LEFT JOIN b ON t.scope = b.scope WHERE b.since IS NULL OR t.moment >= b.since", "docs"))
def retention_samples(spark, sf_dir):
    return _retained(spark, sf_dir, "samples")
