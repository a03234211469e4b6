"""Queries over the owners of cached blobs: inventories compared, owners resolved, and what their maintenance keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import content
from tidemark.plans.registry import query
from tidemark.sources.derived import text
from tidemark.sources.tables import table

_HASHED = "d AS (SELECT doc_id AS k, sha256('b' || doc_id) AS sha256, strlen(text) AS size FROM documents WHERE text IS NOT NULL)"
#: By kind of owner: whether k has it, what it is called, and what becomes of it.
_OWNERS = """
    SELECT k, sha256, size, 1 AS place, 'reader-v2/' || sha256('l' || (k % 50)) AS owner, CASE WHEN k % 50 % 3 = 0 THEN 'live' ELSE 'released' END AS resolution FROM d WHERE k % 2 = 0
    UNION ALL SELECT k, sha256, size, 2, 'package/' || sha256('p' || (k % 20)) || '/' || sha256('r' || (k % 9)), CASE WHEN (k % 20 + k % 9) % 3 <> 0 THEN CASE WHEN k % 7 = 0 OR (k % 9 = 4 AND k % 5 = 0) THEN 'unknown' ELSE 'live' END WHEN k % 20 = 10 OR (k % 2 = 0 AND k % 20 % 9 = k % 9) THEN 'unknown' ELSE 'released' END FROM d WHERE k % 3 <> 0
    UNION ALL SELECT k, sha256, size, 3, 'transfers/' || sha256('a') || '/up/' || sha256, CASE WHEN k % 10 = 0 THEN CASE WHEN k % 20 = 0 THEN 'unknown' ELSE 'live' END WHEN k % 45 = 0 THEN 'unknown' WHEN k % 25 = 0 AND k % 75 <> 0 THEN 'unknown' ELSE 'released' END FROM d WHERE k % 5 = 0
    UNION ALL SELECT k, sha256, size, 4, 'app/doc-' || k, CASE WHEN k % 14 = 0 THEN 'released' WHEN k % 21 = 0 THEN 'unavailable' ELSE 'unknown' END FROM d WHERE k % 7 = 0
    UNION ALL SELECT k, sha256, size, 5, 'custom', 'unknown' FROM d WHERE k % 11 = 0
"""


def _entries(spark, sf_dir):
    k, digest = F.col("doc_id"), (lambda c: F.sha2(c, 256))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(k.alias("k"), digest(text("b", k)).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    k = F.col("k")
    owners = [
        F.when(k % 2 == 0, F.concat(F.lit("reader-v2/"), digest(text("l", k % 50)))), F.when(k % 3 != 0, F.concat(F.lit("package/"), digest(text("p", k % 20)), F.lit("/"), digest(text("r", k % 9)))),
        F.when(k % 5 == 0, F.concat(F.lit("transfers/"), digest(F.lit("a")), F.lit("/up/"), F.col("sha256"))), F.when(k % 7 == 0, text("app/doc-", k)), F.when(k % 11 == 0, F.lit("custom")),
    ]
    return docs.withColumn("owners", F.filter(F.array(*owners), lambda o: o.isNotNull()))


def _lifetimes(entries):
    return entries.select((F.col("k") % 50).alias("l")).filter("l % 3 = 0").distinct().select(F.sha2(text("l", F.col("l")), 256).alias("name"))


def _states(entries):
    k, digest = F.col("k"), (lambda c: F.sha2(c, 256))
    packed = entries.withColumns({"p": k % 20, "r": k % 9}).filter("(p + r) % 3 != 0").groupBy("p", "r").agg(F.collect_list(F.when(k % 7 != 0, F.col("sha256"))).alias("items"))
    wrong = (F.col("r") == 4) & (F.col("p") % 5 == 0)
    manifests = packed.select(digest(text("p", F.col("p"))).alias("package"), digest(text("r", F.col("r"))).alias("revision"), text("p", F.col("p")).alias("package_id"), F.when(wrong, "x").otherwise(text("r", F.col("r"))).alias("revision_id"), "items")
    p = F.col("p")
    pointers = entries.select((k % 20).alias("p")).filter("p % 2 = 0").distinct().select(digest(text("p", p)).alias("package"), F.when(p == 10, " ").otherwise(text("r", p % 9)).alias("payload"))
    key = F.concat(F.lit("transfers/"), digest(F.lit("a")), F.lit("/up/"), F.col("sha256")).alias("key")
    transfers = entries.filter(k % 10 == 0).select(key, "sha256", F.col("bytes").alias("size"), F.when(k % 20 == 0, "down").otherwise("up").alias("direction"), F.lit(1).alias("schema"))
    cleanups = entries.filter(k % 15 == 0).select(key, F.when(k % 45 == 0, "2").otherwise("1").alias("payload"))
    repairs = entries.filter(k % 25 == 0).select(key, "sha256", F.when(k % 75 == 0, "completed").otherwise("pending").alias("state"), F.lit(1).alias("schema"))
    hosts = entries.filter((k % 14 == 0) | (k % 21 == 0)).select("sha256", text("app/doc-", k).alias("owner"), F.when(k % 14 == 0, "released").otherwise("unavailable").alias("resolution"))
    return content.owner_states(entries, _lifetimes(entries), manifests, pointers, transfers, cleanups, repairs, hosts)


@query(f"""
    WITH {_HASHED}, o AS ({_OWNERS}), kept AS (SELECT k, string_agg(owner, ',' ORDER BY place) AS owners, bool_or(place = 1) AS read FROM o WHERE place <> 1 OR resolution = 'live' GROUP BY k),
    m AS (SELECT d.k, d.sha256, coalesce(CASE WHEN k % 4 <> 1 THEN size + k % 3 END, 0) + CASE WHEN k % 6 = 0 THEN 10 ELSE 0 END AS on_disk, size, k % 13 <> 0 AS known, k % 4 <> 1 AS there FROM d)
    SELECT m.sha256, CAST(CASE WHEN known AND coalesce(read, false) THEN greatest(on_disk, size) ELSE on_disk END AS BIGINT) AS bytes, CASE WHEN known THEN coalesce(owners, '') ELSE 'recovered/unknown' END AS owners FROM m LEFT JOIN kept ON kept.k = m.k WHERE known OR there
""")
def cache_inventory(spark, sf_dir):
    entries, k = _entries(spark, sf_dir), F.col("k")
    files = entries.select("sha256", F.when(k % 4 != 1, F.col("bytes") + k % 3).alias("size"), F.when(k % 6 == 0, 10).otherwise(0).alias("partial"))
    found = content.inventory(entries.filter(k % 13 != 0).select("sha256", "bytes", "owners"), files, _lifetimes(entries))
    return found.select("sha256", "bytes", F.array_join("owners", ",").alias("owners"))


@query(f"WITH {_HASHED} SELECT sha256, owner, resolution FROM ({_OWNERS})")
def cache_owner_states(spark, sf_dir):
    return _states(_entries(spark, sf_dir))


@query(f"WITH {_HASHED}, o AS ({_OWNERS}) SELECT sha256, coalesce((SELECT string_agg(owner, ',' ORDER BY place) FROM o WHERE o.k = d.k AND resolution <> 'released'), '') AS owners FROM d")
def cache_owners_kept(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return content.maintained(entries, _states(entries)).select("sha256", F.array_join("owners", ",").alias("owners"))


@query(f"""
    WITH {_HASHED}, o AS ({_OWNERS})
    SELECT count(*) AS examined, count(*) FILTER (resolution = 'live') AS live, count(*) FILTER (resolution = 'released') AS released, count(*) FILTER (resolution = 'unknown') AS unknown, count(*) FILTER (resolution = 'unavailable') AS unavailable,
        (SELECT CAST(sum(size) AS BIGINT) FROM d WHERE k IN (SELECT k FROM o WHERE resolution <> 'released')) AS protected_bytes FROM o
""")
def cache_owner_totals(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return content.maintenance_totals(entries.select("sha256", "bytes", "owners"), _states(entries))
