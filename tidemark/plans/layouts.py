"""Queries over stored layouts, deep documents, large graphs, as-of joins and access kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import feed, graphs, json_merge, membership, queries
from tidemark.operators.numbering import lot_of
from tidemark.plans.querying import PARTS, _parts
from tidemark.plans.registry import query
from tidemark.sources import derived, layouts
from tidemark.sources.derived import sql
from tidemark.sources.scratch import scratch, stored
from tidemark.sources.tables import table


def _once(spark, sf_dir, name, write):
    """A layout of these tables, written once a session; its folder."""
    known = spark.__dict__.setdefault("_tidemark_layouts", {})
    if (sf_dir, name) not in known:
        path = f"{scratch(spark, name)}/layout"
        write(path)
        known[sf_dir, name] = path
    return known[sf_dir, name]


def _index(spark, sf_dir):
    """The parts' indexes by size and by name, as a stored layout."""

    def write(path):
        parts = _parts(spark, sf_dir)
        k = F.col("p_partkey")
        name = F.concat(F.element_at(F.array(F.lit("z"), F.lit("😀"), F.lit("～"), F.lit("é")), (k % 4 + 1).cast("int")), (k % 100).cast("string"))
        layouts.write_index(queries.index_entries(parts, {"size": queries.key_token(F.col("size")), "name": queries.key_token(name, "text")}), path)

    return layouts.read_index(spark, _once(spark, sf_dir, "part-index", write))


def _token(n):
    """The key token of a small number."""
    return f"28{n:015x}"


def _size(key):
    return F.conv(F.substring(key, 3, 15), 16, 10).cast("int").alias("size")


@query(f"WITH {PARTS} SELECT id, size FROM parts WHERE NOT deleted AND size BETWEEN 10 AND 20 ORDER BY size, id LIMIT 50")
def stored_index_between(spark, sf_dir):
    return layouts.index_page(_index(spark, sf_dir), "size", 50, low=_token(10), high=_token(20)).select("id", _size("key"))


@query(f"WITH {PARTS} SELECT id, size FROM parts WHERE NOT deleted AND size >= 10 AND (size > 12 OR (size = 12 AND id > 'p3')) ORDER BY size, id LIMIT 40")
def stored_index_page_after(spark, sf_dir):
    return layouts.index_page(_index(spark, sf_dir), "size", 40, low=_token(10), after=(_token(12), "p3")).select("id", _size("key"))


@query(f"WITH {PARTS} SELECT id, size FROM parts WHERE NOT deleted AND (size < 12 OR (size = 12 AND id < 'p3')) ORDER BY size DESC, id DESC LIMIT 40")
def stored_index_page_before(spark, sf_dir):
    return layouts.index_page(_index(spark, sf_dir), "size", 40, True, low=_token(0), before=(_token(12), "p3")).select("id", _size("key"))


@query(f"WITH {PARTS} SELECT count(*) AS n FROM parts WHERE NOT deleted AND size BETWEEN 10 AND 20")
def stored_index_count(spark, sf_dir):
    return layouts.index_count(_index(spark, sf_dir), "size", low=_token(10), high=_token(20))


@query(f"""
    WITH {PARTS}, named AS (SELECT id, p_partkey % 4 AS c, 's' || ['z', '😀', '～', 'é'][p_partkey % 4 + 1] || (p_partkey % 100) AS key, CAST(p_partkey % 100 AS VARCHAR) AS rest FROM parts WHERE NOT deleted)
    SELECT key, id, row_number() OVER (ORDER BY CASE c WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END, rest, id) AS place FROM named
""")
def stored_index_walk(spark, sf_dir):
    """All pages of the index by names, some beyond the basic plane: their UTF-16 order is not that of UTF-8. The place follows from the walk."""
    index, pages, cursor, many = _index(spark, sf_dir), [], None, 0
    while True:
        page = layouts.index_page(index, "name", 5000, after=cursor).collect()
        pages += [(r["key"], r["id"], many + i + 1) for i, r in enumerate(page)]
        many += len(page)
        if len(page) < 5000:
            return spark.createDataFrame(pages, "key string, id string, place long")
        cursor = (page[-1]["key"], page[-1]["id"])


_CURSORS = "SELECT i AS cursor, 's' || (i % 5) AS scope, (i * 7919) % (SELECT max(event_id) + 50 FROM events) AS since FROM (SELECT DISTINCT user_id AS i FROM events)"


@query(sql(f""", cursors AS ({_CURSORS}),
    ranked AS (SELECT c.cursor, d.version, d.id, row_number() OVER (PARTITION BY c.cursor ORDER BY d.version) AS r, count(*) OVER (PARTITION BY c.cursor) AS n FROM cursors c JOIN docs d ON c.scope = d.scope AND d.version > c.since),
    facts AS (SELECT cursor, max(CASE WHEN r <= 20 THEN version END) AS checkpoint, max(n) > 20 AS has_more FROM ranked GROUP BY cursor)
    SELECT c.cursor, c.scope, r.version, r.id, coalesce(f.has_more, false) AS has_more, coalesce(f.checkpoint, c.since) AS checkpoint
    FROM cursors c LEFT JOIN facts f ON c.cursor = f.cursor LEFT JOIN ranked r ON c.cursor = r.cursor AND r.r <= 20""", "docs"))
def feed_pages_of_cursors(spark, sf_dir):
    """A page for each of many cursors, from a feed bucketed by version; a scope that doesn't exist and positions past the head among them."""
    path = _once(spark, sf_dir, "feed", lambda path: layouts.write_feed(derived.documents(spark, sf_dir), path, width=1024))
    events = table(spark, sf_dir, "events")
    top = events.agg((F.max("event_id") + 50).alias("_top"))
    i = F.col("user_id")
    cursors = events.select("user_id").distinct().crossJoin(F.broadcast(top)).select(i.alias("cursor"), derived.text("s", i % 5).alias("scope"), (i * 7919 % F.col("_top")).alias("since"))
    found = layouts.pages(spark.read.parquet(path), cursors, 20, width=1024)
    return found.select("cursor", "scope", "version", "id", "has_more", "checkpoint")


@query("""
    WITH e AS (SELECT event_id, user_id % 20 AS k, epoch_us(ts) AS t FROM events), samples AS (SELECT k, t, event_id AS head FROM e WHERE event_id % 3 = 0),
    probes AS (SELECT event_id, k, t - 3600000000 * (event_id % 50) AS t FROM e WHERE event_id % 3 <> 0),
    best AS (SELECT k, t, max(head) AS head FROM samples GROUP BY k, t)
    SELECT p.event_id, b.head AS horizon FROM probes p ASOF LEFT JOIN best b ON p.k = b.k AND p.t >= b.t
""")
def feed_heads_as_of(spark, sf_dir):
    """The head each feed had at each probe's own cutoff."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    samples = e.filter("event_id % 3 = 0").select("k", "at", F.col("event_id").alias("head"))
    probes = e.filter("event_id % 3 != 0").select("event_id", "k", (F.col("at") - F.lit(3_600_000_000) * (F.col("event_id") % 50)).alias("at"))
    return feed.as_of(probes, samples, ["k"], "at", "head", lot_of(F.col("at") / 1_000_000), "horizon").select("event_id", "horizon")


_ACCESS = """SELECT principal, scope, id, version, granted FROM (SELECT *, row_number() OVER (PARTITION BY principal, scope, id ORDER BY version DESC) AS rn FROM changes_) WHERE rn = 1"""


@query("""
    WITH w AS (SELECT 's' || (user_id % 4) AS scope, 'u' || user_id AS id, event_id + 1 AS version, event_type = 'error' AS deleted, list_distinct(['p' || (event_id % 3), 'p' || (event_id % 5)]) AS readers FROM events),
    f AS (SELECT *, coalesce(last_value(CASE WHEN NOT deleted THEN readers END IGNORE NULLS) OVER (PARTITION BY scope, id ORDER BY version ROWS UNBOUNDED PRECEDING), []) AS now_ FROM w),
    g AS (SELECT *, coalesce(lag(now_) OVER (PARTITION BY scope, id ORDER BY version), []) AS before_ FROM f),
    changes_ AS (SELECT scope, id, version, unnest(now_) AS principal, true AS granted FROM g UNION ALL SELECT scope, id, version, unnest(list_filter(before_, lambda p: NOT list_contains(now_, p))), false FROM g)
    """ + _ACCESS)
def membership_kept(spark, sf_dir):
    """Access rows folded batch by batch, twenty batches, from the rows before each."""
    writes = derived.writes(spark, sf_dir)
    width = writes.agg(F.max("version")).first()[0] // 20 + 1
    access = membership.access_rows(writes.filter(F.col("version") < width), ["scope", "id"])
    for n in range(1, 20):
        access = stored(access, "access")
        batch = writes.filter((F.col("version") >= n * width) & (F.col("version") < (n + 1) * width))
        access = membership.merge_access(access, stored(membership.access_changes(access, batch, ["scope", "id"]), "access-changes"), ["scope", "id"])
    return access.select("principal", "scope", "id", "version", "granted")


_DEEP = "'{\"a\":{\"b\":{\"c\":{\"d\":{' || {0} || '},\"x\":1}}}}'"


@query("""
    WITH m AS (SELECT p_partkey AS k, p_size AS z, p_brand AS b FROM part)
    SELECT k AS p_partkey, '{"a":{"b":{"c":{"d":{' || concat_ws(',', '"brand":"' || CASE WHEN k % 5 = 0 THEN 'server' ELSE b END || '"', '"hits":' || (10 + CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END),
            '"size":' || CASE WHEN k % 4 = 0 THEN z + 2 WHEN k % 3 = 0 THEN z + 1 ELSE z END, '"tags":[' || concat_ws(',', CASE WHEN k % 5 <> 0 THEN '"t"' END, CASE WHEN k % 6 = 0 THEN '"mine"' END) || ']') || '},"x":1}}}}' AS json,
        CASE WHEN k % 12 = 0 THEN '/a/b/c/d/size' ELSE '' END AS conflicts FROM m
""")
def merge_deep_members(spark, sf_dir):
    """Objects five levels down, whose sides edit different members, with a counter and a set that no schema names."""
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")

    def doc(size, brand, hits, tags):
        return F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(size.alias("size"), brand.alias("brand"), hits.alias("hits"), tags.alias("tags")).alias("d"), F.lit(1).alias("x")).alias("c")).alias("b")).alias("a")))

    tags = F.array(F.lit("t"))
    rows = table(spark, sf_dir, "part").select(
        k, doc(z, F.col("p_brand"), F.lit(10), tags).alias("base"),
        doc(z + F.when(k % 3 == 0, 1).otherwise(0), F.col("p_brand"), F.lit(10) + F.when(k % 2 == 0, 3).otherwise(0), F.when(k % 6 == 0, F.array(F.lit("t"), F.lit("mine"))).otherwise(tags)).alias("local"),
        doc(z + F.when(k % 4 == 0, 2).otherwise(0), F.when(k % 5 == 0, F.lit("server")).otherwise(F.col("p_brand")), F.lit(10) + F.when(k % 3 == 0, 4).otherwise(0), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(tags)).alias("server"),
    )
    merged = json_merge.merge_json(rows, {"/a/b/c/d/tags"}, {"/a/b/c/d/hits"}, "p_partkey")
    return merged.select("p_partkey", "json", F.array_join("conflicts", ",").alias("conflicts"))


@query("""
    WITH RECURSIVE n AS (SELECT DISTINCT p_partkey AS node FROM part), e AS (SELECT node, node // 2 AS needs FROM n WHERE node > 1 UNION SELECT node, node - 3 FROM n WHERE node % 10 = 0 UNION SELECT node, node + 1 FROM n WHERE node % 500 = 498),
    k AS (SELECT e.node, e.needs FROM e JOIN n ON e.needs = n.node),
    back AS (SELECT node, needs FROM k UNION SELECT b.node, k.needs FROM back b JOIN k ON b.needs = k.node), bad AS (SELECT DISTINCT node FROM back WHERE node = needs),
    lost AS (SELECT node FROM bad UNION SELECT DISTINCT node FROM back WHERE needs IN (SELECT node FROM bad)),
    walk(node, depth) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM lost) UNION SELECT k.node, w.depth + 1 FROM walk w JOIN k ON k.needs = w.node WHERE k.node NOT IN (SELECT node FROM lost))
    SELECT n.node, CASE WHEN n.node NOT IN (SELECT node FROM lost) THEN (SELECT max(depth) FROM walk w WHERE w.node = n.node) END AS depth FROM n
""")
def graph_order(spark, sf_dir):
    """Depths of the parts under made-up needs, with cycles and what depends on these; levels are peeled while many edges are left."""
    n = F.col("node")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).distinct()
    edges = nodes.filter(n > 1).select("node", F.floor(n / 2).cast("long").alias("needs")).union(nodes.filter(n % 10 == 0).select("node", n - 3)).union(nodes.filter(n % 500 == 498).select("node", n + 1))
    return graphs.ancestors_first(nodes, edges, 1000)

