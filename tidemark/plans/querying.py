"""Queries over collections by index, page and key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import queries
from tidemark.operators.queries import Range
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table

PARTS = "parts AS (SELECT 'p' || p_partkey AS id, p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS size, p_retailprice AS price, p_partkey % 10 = 0 AS deleted, p_brand FROM part)"


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(derived.text("p", k).alias("id"), k, F.when(k % 13 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"), (k % 10 == 0).alias("deleted"), "p_brand")


def _sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"WITH {PARTS} SELECT id, size FROM parts WHERE NOT deleted AND {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


@query(_sql("size BETWEEN 10 AND 20", "size, id", 50))
def index_between(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range("size", 10, 20), limit=50).select("id", "size")


@query(_sql("size = 7", "id", 50))
def index_equal(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range.equal("size", 7), limit=50).select("id", "size")


@query(_sql("size IS NULL", "id", 50))
def index_null(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range.equal("size", None), limit=50).select("id", "size")


@query(_sql("size >= 30", "size DESC, id DESC", 50))
def index_from_desc(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range("size", 30, descending=True), limit=50).select("id", "size")


@query(_sql("(size < 5 OR size IS NULL)", "size NULLS FIRST, id", 200))
def index_before(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range("size", high=5, high_inclusive=False), limit=200).select("id", "size")


@query(_sql("true", "size NULLS FIRST, id", 300))
def index_all(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), index=Range("size"), limit=300).select("id", "size")


@query(f"WITH {PARTS} SELECT id, size FROM parts WHERE size >= 10 AND (size > 12 OR (size = 12 AND id > 'p3')) ORDER BY size, id LIMIT 40")
def index_page_after(spark, sf_dir):
    return queries.page_after(_parts(spark, sf_dir), Range("size", 10), 12, "p3", 40).select("id", "size")


@query(f"WITH {PARTS} SELECT id, size FROM parts WHERE size < 12 OR size IS NULL OR (size = 12 AND id < 'p3') ORDER BY size DESC NULLS LAST, id DESC LIMIT 40")
def index_page_before_desc(spark, sf_dir):
    return queries.page_after(_parts(spark, sf_dir), Range("size", descending=True), 12, "p3", 40).select("id", "size")


@query(f"WITH {PARTS} SELECT count(*) AS n FROM parts WHERE NOT deleted AND size BETWEEN 10 AND 20")
def index_count(spark, sf_dir):
    return queries.count(_parts(spark, sf_dir), index=Range("size", 10, 20))


@query("SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '0' ELSE '2' || CASE WHEN v >= 0 THEN '8' ELSE '7' END || lpad(lower(printf('%x', CASE WHEN v >= 0 THEN v ELSE v + 1152921504606846976 END)), 15, CASE WHEN v >= 0 THEN '0' ELSE 'f' END) END AS token FROM (SELECT p_partkey, CAST(p_size - 25 AS BIGINT) AS v FROM part)")
def index_key_token(spark, sf_dir):
    k = F.col("p_partkey")
    token = queries.key_token(F.when(k % 13 != 0, F.col("p_size") - 25))
    return table(spark, sf_dir, "part").select(k, F.lower(token).alias("token"))


#: A double's bits in SQL, in the order of key tokens.
_REAL = """CASE WHEN x IS NULL THEN '0' WHEN isnan(x) THEN '4ffffffffffffffff~' ELSE '4' || (SELECT string_agg(printf('%x', CAST(CAST(substr(o, i, 4) AS BIT) AS INTEGER)), '' ORDER BY i)
        FROM (SELECT CASE WHEN x < 0 THEN translate(b, '01', '10') ELSE '1' || substr(b, 2) END AS o FROM (SELECT CAST(CAST(CASE WHEN x = 0 THEN 0 ELSE x END AS BIT) AS VARCHAR) AS b)), range(1, 65, 4) r(i)) END"""


def _doubles():
    """Prices and values over all magnitudes, with both infinities, NaN, zeros and the least double."""
    k, v = F.col("event_id"), F.col("value")
    odd = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 5e-324, None]
    found = F.when(k % 2 == 0, v * F.pow(F.lit(2.0), (k % 2000 - 1000).cast("double"))).otherwise(-v)
    for i, x in enumerate(odd):
        found = F.when(k % 50 == i, F.lit(x).cast("double")).otherwise(found)
    return found


_DOUBLES = "CASE event_id % 50 WHEN 6 THEN NULL WHEN 5 THEN 5e-324 WHEN 4 THEN -0.0::DOUBLE WHEN 3 THEN 0 WHEN 2 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 0 THEN 'inf'::DOUBLE ELSE CASE WHEN event_id % 2 = 0 THEN value * pow(2.0, event_id % 2000 - 1000) ELSE -value END END"


@query(f"SELECT event_id, {_REAL} AS token FROM (SELECT event_id, {_DOUBLES} AS x FROM events)")
def index_key_token_real(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", queries.key_token(_doubles(), "real").alias("token"))


@query("""
    SELECT event_id, '5' || printf('%016x', epoch_us(ts) * 10 + 621355968000000000) AS instant, '6' || printf('%08x', datediff('day', DATE '0001-01-01', CAST(ts AS DATE))) AS day,
        CASE WHEN event_id % 9 = 0 THEN '0' ELSE 's' || event_type END AS text, CASE WHEN event_id % 3 = 0 THEN '11' ELSE '10' END AS flag FROM events
""")
def index_key_token_kinds(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k, queries.key_token(F.col("ts"), "instant").alias("instant"), queries.key_token(F.to_date("ts"), "date").alias("day"),
        queries.key_token(F.when(k % 9 != 0, F.col("event_type")), "text").alias("text"), queries.key_token(k % 3 == 0, "boolean").alias("flag"),
    )


def _entries(spark, sf_dir):
    return queries.index_entries(_parts(spark, sf_dir), {"size": queries.key_token(F.col("size")), "price": queries.key_token(F.col("price"), "real"), "brand": queries.key_token(F.col("p_brand"), "text")})


@query(f"""
    WITH {PARTS} SELECT 'size' AS "index", CASE WHEN size IS NULL THEN '0' ELSE printf('28%015x', size) END AS key, id FROM parts WHERE NOT deleted
    UNION ALL SELECT 'price', {_REAL.replace(" x", " price").replace("(x", "(price")}, id FROM parts WHERE NOT deleted UNION ALL SELECT 'brand', 's' || p_brand, id FROM parts WHERE NOT deleted
""")
def index_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(f"WITH {PARTS} SELECT id, size, price FROM parts WHERE NOT deleted AND (size > 12 OR (size = 12 AND id > 'p3')) AND size <= 40 ORDER BY size, id LIMIT 60")
def index_entry_page(spark, sf_dir):
    token = lambda n: f"28{n:015x}"
    page = queries.entry_page(_entries(spark, sf_dir), "size", token(5), token(40), (token(12), "p3"), 60)
    return queries.rows_of(page, _parts(spark, sf_dir)).select("id", "size", "price")


@query("""
    WITH s AS (SELECT p_brand, p_type AS name, p_size AS version FROM part GROUP BY ALL), g AS (SELECT p_brand, string_agg(name || '@' || version, ';' ORDER BY name || '@' || version) AS signature FROM s GROUP BY p_brand),
    o AS (SELECT p_brand, string_agg(name || '@' || version, ';' ORDER BY name || '@' || version) AS old FROM s WHERE p_brand <> 'Brand#11' AND (p_brand < 'Brand#3' OR version <> 7) GROUP BY p_brand)
    SELECT g.p_brand, signature FROM g LEFT JOIN o ON g.p_brand = o.p_brand WHERE old IS DISTINCT FROM signature
""")
def index_rebuild(spark, sf_dir):
    indexes = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("name"), F.col("p_size").alias("version")).distinct()
    before = indexes.filter("p_brand <> 'Brand#11' and (p_brand < 'Brand#3' or version <> 7)")
    return queries.to_rebuild(queries.index_signature(before, ["p_brand"]), queries.index_signature(indexes, ["p_brand"]), ["p_brand"])


@query(_sql("p_brand <> 'Brand#11'", "price DESC, id", 25, 10))
def query_order_skip_limit(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), F.col("p_brand") != "Brand#11", order=[F.col("price").desc()], skip=10, limit=25).select("id", "size")


@query(_sql("size > 25", "id", 100, 20))
def query_selective_page(spark, sf_dir):
    return queries.select(_parts(spark, sf_dir), F.col("size") > 25, skip=20, limit=100).select("id", "size")


@query(f"WITH {PARTS} SELECT count(*) AS n FROM parts WHERE NOT deleted AND size > 25")
def collection_count(spark, sf_dir):
    return queries.count(_parts(spark, sf_dir), F.col("size") > 25)


@query(f"WITH {PARTS} SELECT id, size, price FROM parts WHERE id IN ('p7', 'p20', 'p35') AND NOT deleted")
def get_by_id(spark, sf_dir):
    return _parts(spark, sf_dir).filter(F.col("id").isin("p7", "p20", "p35") & ~F.col("deleted")).select("id", "size", "price")


_KV = "kv AS (SELECT CASE event_id % 4 WHEN 0 THEN 'blob/' WHEN 1 THEN 'job/' WHEN 2 THEN 'package/' ELSE 'x/' END || event_id AS key, event_id % 5 AS revision, event_id % 30 AS moment, props FROM events)"


def _kv(spark, sf_dir):
    k = F.col("event_id")
    prefix = F.when(k % 4 == 0, "blob/").when(k % 4 == 1, "job/").when(k % 4 == 2, "package/").otherwise("x/")
    return table(spark, sf_dir, "events").select(F.concat(prefix, k.cast("string")).alias("key"), (k % 5).alias("revision"), (k % 30).alias("at"), "props")


@query(f"WITH {_KV} SELECT key, revision FROM kv WHERE starts_with(key, 'job/') AND key > 'job/3' ORDER BY key LIMIT 128")
def kv_page(spark, sf_dir):
    return queries.prefix_page(_kv(spark, sf_dir), "job/", "job/3", 128).select("key", "revision")


@query(f"""WITH {_KV}, m AS (SELECT event_id // 3 AS batch, CASE event_id % 4 WHEN 0 THEN 'blob/' WHEN 1 THEN 'job/' WHEN 2 THEN 'package/' ELSE 'y/' END || event_id AS key, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 50 = 0 THEN 99 ELSE event_id % 5 END AS expected FROM events)
    SELECT batch, bool_and(revision IS NOT DISTINCT FROM expected AND batch % 10 <> 0) AS applied, count(*) AS n FROM m LEFT JOIN kv ON m.key = kv.key GROUP BY batch""")
def kv_compare_and_set(spark, sf_dir):
    k = F.col("event_id")
    prefix = F.when(k % 4 == 0, "blob/").when(k % 4 == 1, "job/").when(k % 4 == 2, "package/").otherwise("y/")
    expected = F.when(k % 4 == 3, F.lit(None)).when(k % 50 == 0, 99).otherwise(k % 5)
    mutations = table(spark, sf_dir, "events").select(F.floor(k / 3).cast("long").alias("batch"), F.concat(prefix, k.cast("string")).alias("key"), expected.cast("long").alias("expected"))
    return queries.compare_and_set(_kv(spark, sf_dir), mutations, F.col("batch") % 10 != 0)


@query(f"""WITH {_KV}, m AS (SELECT event_id // 3 AS batch, CASE event_id % 4 WHEN 0 THEN 'blob/' WHEN 1 THEN 'job/' WHEN 2 THEN 'package/' ELSE 'y/' END || event_id AS key, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 50 = 0 THEN 99 ELSE event_id % 5 END AS expected,
        CASE WHEN event_id % 7 <> 0 THEN 'v' || event_id END AS v FROM events),
    b AS (SELECT batch FROM m LEFT JOIN kv ON m.key = kv.key GROUP BY batch HAVING bool_and(revision IS NOT DISTINCT FROM expected AND batch % 10 <> 0)),
    w AS (SELECT key AS k, v FROM m WHERE batch IN (SELECT batch FROM b))
    SELECT coalesce(key, k) AS key, CASE WHEN k IS NULL THEN revision ELSE coalesce(revision, 0) + 1 END AS revision, CASE WHEN k IS NULL THEN props ELSE v END AS value
    FROM kv FULL JOIN w ON kv.key = w.k WHERE k IS NULL OR v IS NOT NULL""")
def kv_write(spark, sf_dir):
    k = F.col("event_id")
    prefix = F.when(k % 4 == 0, "blob/").when(k % 4 == 1, "job/").when(k % 4 == 2, "package/").otherwise("y/")
    expected = F.when(k % 4 == 3, F.lit(None)).when(k % 50 == 0, 99).otherwise(k % 5)
    mutations = table(spark, sf_dir, "events").select(
        F.floor(k / 3).cast("long").alias("batch"), F.concat(prefix, k.cast("string")).alias("key"), expected.cast("long").alias("expected"), F.when(k % 7 != 0, derived.text("v", k)).alias("value")
    )
    return queries.write_records(_kv(spark, sf_dir).withColumnRenamed("props", "value"), mutations, F.col("batch") % 10 != 0)


@query("SELECT p_brand, string_agg(p_type || '@' || p_size, ';' ORDER BY p_type || '@' || p_size) AS signature FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY p_brand")
def index_signature(spark, sf_dir):
    indexes = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("name"), F.col("p_size").alias("version")).distinct()
    return queries.index_signature(indexes, ["p_brand"])
