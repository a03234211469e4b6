"""Queries over clocks, ids and the wire format."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions import clock, wire
from tidemark.functions.ids import id_valid
from tidemark.operators import clocks
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table


@query("SELECT event_id, lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 15, '0') || ':' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') || ':n' || (user_id % 8) AS stamp FROM events")
def hlc_encode(spark, sf_dir):
    stamp = clock.encode(derived.millis("ts"), F.col("event_id") % 1000, derived.text("n", F.col("user_id") % 8))
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"))


STAMPS = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 15, '0') || ':' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') || ':' || CASE WHEN event_id % 11 = 0 THEN 'bad node' ELSE 'n' || (user_id % 8) END END AS s FROM events"""


@query(f"""SELECT event_id, CASE WHEN ok THEN CAST(substr(s, 1, 15) AS BIGINT) END AS wall, CASE WHEN ok THEN CAST(substr(s, 17, 6) AS INTEGER) END AS counter, CASE WHEN ok THEN substr(s, 24) END AS node
    FROM (SELECT *, regexp_full_match(s, '[0-9]{{15}}:[0-9]{{6}}:[A-Za-z0-9._~-]{{0,64}}') AS ok FROM ({STAMPS}))""")
def hlc_parse(spark, sf_dir):
    k = F.col("event_id")
    stamp = F.when(k % 9 == 0, k.cast("string")).otherwise(clock.encode(derived.millis("ts"), k % 1000, F.when(k % 11 == 0, "bad node").otherwise(derived.text("n", F.col("user_id") % 8))))
    parts = clock.parse(F.col("s"))
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("s")).select("event_id", *(v.alias(n) for n, v in parts.items()))


@query("""
    WITH p AS (SELECT event_id, user_id % 8 AS node, epoch_us(ts) // 1000 - CASE WHEN event_id % 3 = 0 THEN 5000000 ELSE 0 END AS physical FROM events),
    w AS (SELECT *, max(physical) OVER (PARTITION BY node ORDER BY event_id) AS wall FROM p)
    SELECT event_id, lpad(CAST(wall AS VARCHAR), 15, '0') || ':' || lpad(CAST(row_number() OVER (PARTITION BY node, wall ORDER BY event_id) - 1 AS VARCHAR), 6, '0') || ':' || node AS stamp FROM w
""")
def hlc_now(spark, sf_dir):
    physical = derived.millis("ts") - F.when(F.col("event_id") % 3 == 0, 5_000_000).otherwise(0)
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("node"), physical.alias("physical"))
    return clocks.now_stamps(events, "node", "event_id", "physical").select("event_id", "stamp")


@query("""
    WITH p AS (SELECT event_id, user_id % 8 AS node, epoch_us(ts) // 1000 - CASE WHEN event_id % 3 = 0 THEN 5000000 ELSE 0 END AS physical, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
    t AS (SELECT event_id, n + max(physical * 2 - n) OVER (PARTITION BY node ORDER BY event_id) AS t FROM p)
    SELECT event_id, t // 2 AS wall, t % 2 AS counter FROM t
""")
def hlc_now_carried(spark, sf_dir):
    """A counter that is full is carried to the wall; here it holds two values."""
    physical = derived.millis("ts") - F.when(F.col("event_id") % 3 == 0, 5_000_000).otherwise(0)
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("node"), physical.alias("physical"))
    return clocks.now_stamps(events, "node", "event_id", "physical", 2).select("event_id", "wall", "counter")


@query("""
    SELECT event_id, lpad(CAST(w + c // 1000000 AS VARCHAR), 15, '0') || ':' || lpad(CAST(c % 1000000 AS VARCHAR), 6, '0') || ':n' AS stamp FROM (SELECT event_id, epoch_us(ts) // 1000 AS w, event_id * 12345 AS c FROM events)
""")
def hlc_encode_carried(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock.encode(derived.millis("ts"), F.col("event_id") * 12345, F.lit("n")).alias("stamp"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts) // 1000 AS p,
        CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + event_id % 7 * 1000 END AS rw, event_id % 5 AS rc FROM events),
    f(node, n, wall, counter, refused) AS (SELECT node, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e WHERE n = 1 UNION ALL
        SELECT e.node, e.n, CASE WHEN coalesce(rw - p > 5500, false) THEN wall ELSE greatest(wall, p, coalesce(rw, -1)) END,
            CASE WHEN coalesce(rw - p > 5500, false) THEN counter WHEN greatest(wall, p, coalesce(rw, -1)) = wall AND coalesce(rw = wall, false) THEN greatest(counter, rc) + 1 WHEN greatest(wall, p, coalesce(rw, -1)) = wall THEN counter + 1
                WHEN coalesce(rw >= p, false) THEN rc + 1 ELSE 0 END,
            refused + CASE WHEN coalesce(rw - p > 5500, false) THEN 1 ELSE 0 END
        FROM f JOIN e ON e.node = f.node AND e.n = f.n + 1)
    SELECT node, max(wall) AS wall, arg_max(counter, n) AS counter, max(refused) AS refused FROM f GROUP BY node
""")
def hlc_update(spark, sf_dir):
    """A fold over each node's events."""
    k = F.col("event_id")
    remote = F.when(k % 3 == 0, clock.encode(derived.millis("ts") + k % 7 * 1000, k % 5, F.lit("r")))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("node"), derived.millis("ts").alias("physical"), remote.alias("remote"))
    return clocks.update_clocks(events, "node", "event_id", "physical", "remote", most_drift=5500)


@query("SELECT user_id, max(lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 15, '0') || ':000000:n' || (user_id % 8)) AS high_water FROM events GROUP BY user_id")
def hlc_high_water(spark, sf_dir):
    stamp = clock.encode(derived.millis("ts"), F.lit(0), derived.text("n", F.col("user_id") % 8))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(stamp).alias("high_water"))


@query("SELECT event_id, CASE WHEN o <= -1000 THEN o ELSE 0 END AS correction FROM (SELECT event_id, (event_id * 37) % 10000 - ((event_id * 11) % 7000 + (event_id * 13) % 9000) // 2 AS o FROM events)")
def clock_correction(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", clock.correction(k * 37 % 10000, k * 11 % 7000, k * 13 % 9000).alias("correction"))


@query("""SELECT event_id, length(i) BETWEEN 1 AND 256 AND NOT regexp_matches(i, '[\\x00-\\x1F]') AS ok FROM
    (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a' || chr(7) WHEN 2 THEN repeat('x', 250 + CAST(event_id % 12 AS INTEGER)) ELSE 'u' || user_id END AS i FROM events)""")
def id_validity(spark, sf_dir):
    k = F.col("event_id")
    i = F.when(k % 5 == 0, "").when(k % 5 == 1, "a\a").when(k % 5 == 2, F.repeat(F.lit("x"), (250 + k % 12).cast("int"))).otherwise(derived.text("u", F.col("user_id")))
    return table(spark, sf_dir, "events").select("event_id", i.alias("i")).select("event_id", id_valid(F.col("i")).alias("ok"))


@query("""
    WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '0' || event_id WHEN 2 THEN '-' || event_id WHEN 3 THEN '9223372036854775807' WHEN 4 THEN '9223372036854775808' ELSE props END AS s FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(s, '(0|[1-9][0-9]{0,18})') THEN try_cast(s AS BIGINT) END AS number FROM t
""")
def wire_int64(spark, sf_dir):
    k = F.col("event_id")
    s = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(F.lit("0"), k)).when(k % 6 == 2, F.concat(F.lit("-"), k)).when(k % 6 == 3, "9223372036854775807").when(k % 6 == 4, "9223372036854775808").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", wire.int64(F.col("s")).alias("number"))


@query("""
    SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'json' WHEN 1 THEN 'base-version-absent' WHEN 2 THEN 'base-version-number' WHEN 3 THEN 'operation-id' WHEN 4 THEN 'document-id' WHEN 5 THEN 'base-version' WHEN 6 THEN 'document' WHEN 7 THEN 'updated-at' END AS fault FROM events
""")
def wire_validate(spark, sf_dir):
    k = F.col("event_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    base = F.when(k % 10 == 2, k.cast("string")).when(k % 10 == 5, F.lit('"01"')).when(k % 10 == 8, F.lit("null")).otherwise(quoted(k.cast("string")))
    stamp = F.when(k % 10 == 7, F.lit("x")).otherwise(clock.encode(derived.millis("ts"), F.lit(0), F.lit("n")))
    own, inner = F.when(k % 10 == 4, F.lit("")).otherwise(derived.text("u", F.col("user_id"))), F.when(k % 10 == 6, F.lit("other")).otherwise(F.when(k % 10 == 4, F.lit("")).otherwise(derived.text("u", F.col("user_id"))))
    json = F.concat(
        F.lit('{"operationId":'), quoted(F.when(k % 10 == 3, F.lit("")).otherwise(derived.text("op", k))), F.lit(',"documentId":'), quoted(own),
        F.when(k % 10 == 1, F.lit("")).otherwise(F.concat(F.lit(',"baseVersion":'), base)), F.lit(',"document":{"id":'), quoted(inner), F.lit(',"updatedAt":'), quoted(stamp), F.lit(',"deleted":false}}'),
    )
    raw = F.when(k % 10 == 0, F.lit('{"operationId":')).otherwise(json)
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", wire.operation(F.col("raw")).alias("op"))
    return rows.select("event_id", wire.operation_fault(F.col("op"), F.col("raw")).alias("fault"))


@query("""
    SELECT event_id, coalesce(code, CASE WHEN status = 401 THEN 'unauthorized' WHEN status = 403 THEN 'forbidden' WHEN status = 413 THEN 'payload-too-large' WHEN status = 429 THEN 'rate-limited' WHEN status >= 500 THEN 'unavailable' ELSE 'invalid-request' END) AS code,
        coalesce(code, CASE WHEN status = 429 THEN 'rate-limited' ELSE '' END) = 'rate-limited' OR status >= 500 AS transient
    FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 413 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 503 ELSE 404 END AS status, CASE WHEN event_id % 5 = 0 THEN 'upgrade-required' END AS code FROM events)
""")
def wire_problem(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(k % 7 == 0, 401).when(k % 7 == 1, 403).when(k % 7 == 2, 413).when(k % 7 == 3, 429).when(k % 7 == 4, 500).when(k % 7 == 5, 503).otherwise(404)
    code, transient = wire.problem(status, F.when(k % 5 == 0, "upgrade-required"))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), transient.alias("transient"))


@query("""
    SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'json' WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'limit' WHEN 4 THEN 'limit' WHEN 5 THEN 'limit' WHEN 6 THEN 'features' END AS fault FROM events
""")
def wire_pull_request(spark, sf_dir):
    k = F.col("event_id")
    at = F.when(k % 9 == 1, F.lit("")).when(k % 9 == 2, F.concat(F.lit('"checkpoint":'), k, F.lit(","))).when(k % 2 == 0, F.lit('"checkpoint":null,')).otherwise(F.concat(F.lit('"checkpoint":"e~h:'), k, F.lit('",')))
    limit = F.when(k % 9 == 3, F.lit('"other":1')).when(k % 9 == 4, F.lit('"limit":"5"')).when(k % 9 == 5, F.lit('"limit":0')).otherwise(F.concat(F.lit('"limit":'), k + 1))
    more = F.when(k % 9 == 6, F.lit(',"features":["removals",7]')).when(k % 9 == 7, F.lit(',"features":["removals"],"replica":"r"')).otherwise(F.lit(""))
    raw = F.concat(F.when(k % 9 == 0, F.lit("[")).otherwise(F.lit("{")), at, limit, more, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", wire.pull_request_fault(raw).alias("fault"))


@query("""
    SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'json' WHEN 1 THEN 'changes' WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'has-more' WHEN 4 THEN 'version' WHEN 5 THEN 'version' WHEN 6 THEN 'version' WHEN 7 THEN 'version'
        WHEN 8 THEN 'document' WHEN 9 THEN 'document' WHEN 10 THEN 'removals' WHEN 11 THEN 'server-time' WHEN 12 THEN 'retention-horizon' END AS fault FROM events
""")
def wire_pull_result(spark, sf_dir):
    k = F.col("event_id")
    case = lambda texts, otherwise: functools.reduce(lambda w, e: w.when(k % 14 == e[0], F.lit(e[1])), texts.items(), F.when(F.lit(False), F.lit(""))).otherwise(otherwise)
    version = case({4: "7", 5: '"007"', 6: '"-1"', 7: '"9223372036854775808"'}, F.concat(F.lit('"'), k, F.lit('"')))
    stamp = F.when(k % 14 == 8, F.lit("2026-01-01T00:00:00Z")).otherwise(clock.encode(derived.millis("ts"), F.lit(0), F.lit("n")))
    deleted = case({9: '"no"'}, F.lit("false"))
    change = F.concat(F.lit('{"document":{"id":"'), derived.text("u", F.col("user_id")), F.lit('","updatedAt":"'), stamp, F.lit('","deleted":'), deleted, F.lit(',"later":{"n":1}},"version":'), version, F.lit("}"))
    changes = F.when(k % 14 == 1, F.lit("{}")).otherwise(F.concat(F.lit("["), change, F.when(k % 14 < 4, F.concat(F.lit(","), change)).otherwise(F.lit("")), F.lit("]")))
    extra = case({10: ',"removals":[null]', 11: ',"serverTime":17', 12: ',"retentionHorizon":"x"'}, F.lit(',"removals":["a"],"serverTime":"17","retentionHorizon":null'))
    at, more = case({2: ""}, F.lit(',"checkpoint":null')), case({3: ',"hasMore":"true"'}, F.lit(',"hasMore":true'))
    raw = F.concat(F.lit('{"changes":'), changes, at, more, extra, F.when(k % 14 == 0, F.lit("")).otherwise(F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", wire.pull_result_fault(raw).alias("fault"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'outcomes' WHEN 1 THEN 'operation-id' WHEN 2 THEN 'kind' WHEN 3 THEN 'kind' WHEN 4 THEN 'version' END AS fault FROM events")
def wire_push_result(spark, sf_dir):
    k = F.col("event_id")
    own = F.when(k % 6 == 1, F.lit("")).otherwise(F.concat(F.lit('"operationId":"op'), k, F.lit('",')))
    kind = F.when(k % 6 == 2, F.lit("0")).when(k % 6 == 3, F.lit('"maybe"')).otherwise(F.concat(F.lit('"'), F.get(F.array(*map(F.lit, wire.OUTCOMES)), (k % 4).cast("int")), F.lit('"')))
    version = F.when(k % 6 == 4, F.lit(',"version":5')).when(k % 4 == 0, F.lit(',"version":"5"')).otherwise(F.lit(""))
    raw = F.concat(F.lit('{"outcomes":'), F.when(k % 6 == 0, F.lit("null")).otherwise(F.concat(F.lit("[{"), own, F.lit('"kind":'), kind, version, F.lit("}]"))), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", wire.push_result_fault(raw).alias("fault"))
