"""Queries over conflict policies and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import clock
from tidemark.operators import merge
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table


def _pairs(spark, sf_dir):
    """Two versions of each order: the fork's and the master's stamp."""
    k = F.col("o_orderkey")
    at = lambda shift: clock.encode(derived.millis("o_orderdate") + shift, F.lit(0), F.lit("n"))
    return table(spark, sf_dir, "orders").select(k, at(k % 3).alias("fork_at"), at(k % 2).alias("master_at"), F.concat(F.lit("f"), k).alias("fork"), F.concat(F.lit("m"), k).alias("master"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > o_orderkey % 2 THEN 'keep-fork' ELSE 'use-master' END AS decision, CASE WHEN o_orderkey % 3 > o_orderkey % 2 THEN 'f' || o_orderkey ELSE 'm' || o_orderkey END AS winner FROM orders")
def policy_lww(spark, sf_dir):
    decided = _pairs(spark, sf_dir).withColumn("decision", merge.last_write_wins(F.col("fork_at"), F.col("master_at")))
    return decided.select("o_orderkey", "decision", F.when(F.col("decision") == "keep-fork", F.col("fork")).otherwise(F.col("master")).alias("winner"))


@query("SELECT o_orderkey, 'm' || o_orderkey AS winner, false AS is_dirty FROM orders")
def policy_server(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", F.col("master").alias("winner"), F.lit(False).alias("is_dirty"))


@query("SELECT o_orderkey, 'f' || o_orderkey AS winner, true AS is_dirty FROM orders")
def policy_client(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", F.col("fork").alias("winner"), F.lit(True).alias("is_dirty"))


CONTENT = T.StructType([
    T.StructField("size", T.LongType()), T.StructField("type", T.StringType()), T.StructField("brand", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("views", T.LongType()), T.StructField("place", T.StructType([T.StructField("hall", T.StringType()), T.StructField("row/bin", T.StringType())])),
])


def _merged(spark, sf_dir):
    k = F.col("p_partkey")
    side = lambda **c: F.struct(
        c.get("size", F.col("p_size").cast("long")).alias("size"), c.get("type", F.col("p_type")).alias("type"), c.get("brand", F.col("p_brand")).alias("brand"), c.get("tags", F.split("p_name", " ")).alias("tags"),
        c.get("views", F.lit(10)).cast("long").alias("views"), F.struct(c.get("hall", F.lit("h0")).alias("hall"), c.get("bin", F.lit("b0")).alias("row/bin")).alias("place"),
    )
    tags = F.split("p_name", " ")
    local = side(
        size=F.col("p_size").cast("long") + F.when(k % 3 == 0, 1).otherwise(0), type=F.when(k % 5 == 0, F.lit("local")).otherwise(F.col("p_type")), views=F.lit(10) + F.when(k % 4 == 1, 3).otherwise(0),
        tags=F.when(k % 7 == 0, F.concat(tags, F.array(F.lit("mine"), F.lit(None)))).otherwise(tags), hall=F.when(k % 8 == 0, "h1").otherwise("h0"), bin=F.when(k % 12 == 0, "b1").otherwise("b0"),
    )
    server = side(
        size=F.col("p_size").cast("long") + F.when(k % 4 == 0, 2).otherwise(0), brand=F.when(k % 6 == 0, F.lit("server")).otherwise(F.col("p_brand")), views=F.lit(10) + F.when(k % 6 == 0, k % 5).otherwise(0),
        tags=F.when((k % 2 == 0) & (k % 10 != 0), F.array_append(F.slice(tags, 2, 9), F.lit("theirs"))).otherwise(tags), hall=F.when(k % 16 == 0, "h2").otherwise("h0"), bin=F.when(k % 9 == 0, "b2").otherwise("b0"),
    )
    rows = table(spark, sf_dir, "part").select(k, side().alias("base"), local.alias("local"), server.alias("server"), (k % 10 == 1).alias("bd"), (k % 10 < 2).alias("ld"), (k % 5 == 1).alias("sd"))
    out = merge.three_way(CONTENT, F.col("base"), F.col("local"), F.col("server"), F.col("bd"), F.col("ld"), F.col("sd"), sets={"/tags"}, counters={"/views"})
    return rows.select("p_partkey", "base", "local", "server", *(v.alias(n) for n, v in out.items()))


# The same in SQL: sides of each slot by key k. Flags: deleted at the base if k % 10 = 1, locally if k % 10 < 2, on the server if k % 5 = 1.
SIDES = """SELECT p_partkey AS k, p_type, p_brand, p_name, p_partkey % 10 = 1 AS bd, p_partkey % 10 < 2 AS ld, p_partkey % 5 = 1 AS sd, p_partkey % 10 < 2 AND p_partkey % 5 = 1 AS dead,
    p_size AS zb, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS zl, p_size + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS zs,
    'h0' AS hb, CASE WHEN p_partkey % 8 = 0 THEN 'h1' ELSE 'h0' END AS hl, CASE WHEN p_partkey % 16 = 0 THEN 'h2' ELSE 'h0' END AS hs,
    'b0' AS nb, CASE WHEN p_partkey % 12 = 0 THEN 'b1' ELSE 'b0' END AS nl, CASE WHEN p_partkey % 9 = 0 THEN 'b2' ELSE 'b0' END AS ns,
    p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AS server_tags, p_partkey % 7 = 0 AS local_tags,
    p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 AND NOT (p_partkey % 2 = 0 AND p_partkey % 10 <> 0) AND p_partkey % 16 <> 0 AND p_partkey % 9 <> 0 AS server_same,
    p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 4 <> 1 AND p_partkey % 8 <> 0 AND p_partkey % 12 <> 0 AS local_same FROM part"""


@query(f"""
    WITH z AS ({SIDES})
    SELECT k AS p_partkey, CAST(CASE WHEN dead THEN zs WHEN zl = zs OR zb = zs THEN zl ELSE zs END AS BIGINT) AS size, CASE WHEN NOT dead AND k % 5 = 0 THEN 'local' ELSE p_type END AS type,
        CASE WHEN k % 6 = 0 THEN 'server' ELSE p_brand END AS brand FROM z
""")
def merge_scalar(spark, sf_dir):
    return _merged(spark, sf_dir).select("p_partkey", F.col("content.size").alias("size"), F.col("content.type").alias("type"), F.col("content.brand").alias("brand"))


@query(f"""
    WITH z AS ({SIDES}), t AS (SELECT k, dead, local_tags, server_tags, string_split(p_name, ' ') AS b FROM z),
    s AS (SELECT *, CASE WHEN local_tags THEN list_concat(b, ['mine', NULL]) ELSE b END AS l, CASE WHEN server_tags THEN list_append(list_slice(b, 2, 10), 'theirs') ELSE b END AS s FROM t),
    both_ AS (SELECT * FROM s WHERE local_tags AND server_tags),
    kept AS (SELECT k, unnest(s) AS x, generate_subscripts(s, 1) AS n, 0 AS part FROM both_), added AS (SELECT k, unnest(l) AS x, generate_subscripts(l, 1) AS n, 1 AS part FROM both_),
    hasb AS (SELECT k, unnest(b) AS x FROM both_), hasl AS (SELECT k, unnest(l) AS x FROM both_), hass AS (SELECT k, unnest(s) AS x FROM both_),
    items AS (SELECT * FROM kept WHERE EXISTS (SELECT 1 FROM hasl h WHERE h.k = kept.k AND h.x IS NOT DISTINCT FROM kept.x) OR NOT EXISTS (SELECT 1 FROM hasb h WHERE h.k = kept.k AND h.x IS NOT DISTINCT FROM kept.x)
        UNION ALL SELECT * FROM added WHERE NOT EXISTS (SELECT 1 FROM hasb h WHERE h.k = added.k AND h.x IS NOT DISTINCT FROM added.x) AND NOT EXISTS (SELECT 1 FROM hass h WHERE h.k = added.k AND h.x IS NOT DISTINCT FROM added.x)),
    firsts AS (SELECT k, coalesce(x, '-') AS x, min(part * 1000 + n) AS place FROM items GROUP BY k, coalesce(x, '-')),
    merged AS (SELECT k, string_agg(x, ',' ORDER BY place) AS tags FROM firsts GROUP BY k)
    SELECT s.k AS p_partkey, CASE WHEN dead THEN array_to_string(s.s, ',') WHEN local_tags AND server_tags THEN m.tags WHEN local_tags THEN array_to_string(s.b, ',') || ',mine,-' ELSE array_to_string(s.s, ',') END AS tags
    FROM s LEFT JOIN merged m ON s.k = m.k
""")
def merge_set(spark, sf_dir):
    return _merged(spark, sf_dir).select("p_partkey", F.array_join("content.tags", ",", "-").alias("tags"))


@query(f"WITH z AS ({SIDES}) SELECT k AS p_partkey, 10 + CASE WHEN k % 6 = 0 THEN k % 5 ELSE 0 END + CASE WHEN NOT dead AND k % 4 = 1 AND NOT (k % 6 = 0 AND k % 5 = 3) THEN 3 ELSE 0 END AS views FROM z")
def merge_counter(spark, sf_dir):
    return _merged(spark, sf_dir).select("p_partkey", F.col("content.views").alias("views"))


_FREE = "CASE WHEN ld <> bd THEN server_same ELSE local_same END"


@query(f"WITH z AS ({SIDES}) SELECT k AS p_partkey, CASE WHEN dead THEN true WHEN ld <> sd AND {_FREE} THEN CASE WHEN ld <> bd THEN ld ELSE sd END ELSE sd END AS deleted, ld <> sd AND NOT {_FREE} AS flag_conflict FROM z")
def merge_delete(spark, sf_dir):
    return _merged(spark, sf_dir).select("p_partkey", "deleted", F.array_contains("conflicts", "(deleted)").alias("flag_conflict"))


@query(f"""
    WITH z AS ({SIDES})
    SELECT k AS p_partkey, CASE WHEN dead THEN '' ELSE concat_ws(',', CASE WHEN ld <> sd AND NOT {_FREE} THEN '(deleted)' END, CASE WHEN zl <> zs AND zb <> zs AND zb <> zl THEN '/size' END,
        CASE WHEN hl <> hs AND hb <> hs AND hb <> hl THEN '/place/hall' END, CASE WHEN nl <> ns AND nb <> ns AND nb <> nl THEN '/place/row~1bin' END) END AS conflicts FROM z
""")
def merge_conflict_paths(spark, sf_dir):
    return _merged(spark, sf_dir).select("p_partkey", F.array_join("conflicts", ",").alias("conflicts"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'defer' WHEN event_id % 5 = 0 THEN 'use-master' ELSE 'use-resolved' END AS decision FROM events")
def merge_handler(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", merge.merge_decision(k % 2 != 0, k % 3 != 0, k % 5 == 0, F.lit("defer")).alias("decision"))


@query("""
    WITH m AS (SELECT p_partkey AS k, p_size AS z FROM part)
    SELECT k AS p_partkey, '{' || concat_ws(',', '"size":' || CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN z + 1 WHEN k % 4 = 0 THEN z + 2 ELSE z END,
            CASE WHEN k % 7 = 0 THEN CASE WHEN k % 5 = 0 THEN '"note":"server"' END ELSE CASE WHEN k % 5 = 0 THEN '"note":"server"' ELSE '"note":null' END END,
            '"place":{' || CASE WHEN k % 9 = 0 THEN '"a/b":[1,{"x":null}],' ELSE '' END || '"hall":' || CASE WHEN k % 8 = 0 AND k % 16 <> 0 THEN '"h1"' WHEN k % 16 = 0 THEN '"h2"' ELSE '"h0"' END || '}',
            CASE WHEN k % 2 = 0 THEN '"mine":true' END) || '}' AS json,
        concat_ws(',', CASE WHEN k % 12 = 0 THEN '/size' END, CASE WHEN k % 35 = 0 THEN '/note' END, CASE WHEN k % 16 = 0 THEN '/place/hall' END) AS conflicts FROM m
""")
def merge_unknown_members(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    body = lambda size, note, hall, more: F.concat(F.lit('{"size":'), size, note, F.lit(',"place":{"hall":"'), hall, F.lit('"'), more[0], F.lit("}"), more[1], F.lit("}"))
    none, null = F.lit(""), F.lit(',"note":null')
    base = body(z, null, F.lit("h0"), (none, none))
    local = body(z + F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 7 == 0, none).otherwise(null), F.when(k % 8 == 0, "h1").otherwise("h0"), (none, F.when(k % 2 == 0, ',"mine":true').otherwise("")))
    server = body(z + F.when(k % 4 == 0, 2).otherwise(0), F.when(k % 5 == 0, ',"note":"server"').otherwise(',"note": null'), F.when(k % 16 == 0, "h2").otherwise("h0"), (F.when(k % 9 == 0, ', "a/b": [1, {"x": null}]').otherwise(""), none))
    merged = table(spark, sf_dir, "part").select(k, merge.merge_members(base, local, server).alias("m"))
    return merged.select("p_partkey", F.col("m.json").alias("json"), F.array_join("m.conflicts", ",").alias("conflicts"))
