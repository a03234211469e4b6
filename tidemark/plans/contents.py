"""Queries over blobs, packages and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import content, packages, readmodel
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.derived import sql
from tidemark.sources.tables import table


@query("SELECT sha256(text) AS sha256, CAST(max(strlen(text)) AS BIGINT) AS size, count(*) AS copies FROM documents GROUP BY sha256(text)")
def blob_dedupe(spark, sf_dir):
    return content.dedupe(table(spark, sf_dir, "documents"), "text")


@query("""
    SELECT doc_id AS id, CASE WHEN strlen(text) > 20000 THEN 'limit' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'invalid' ELSE 'verified' END AS result FROM documents
""")
def blob_verify(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    expected = d.select(k.alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    stored = d.filter(k % 5 != 0).select(k.alias("id"), F.when(k % 7 == 0, F.concat("text", F.lit("!"))).when(k % 11 == 0, F.concat(F.lit("~"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text")).alias("content"))
    return content.verify(expected, stored, "content", 20_000)


@query("SELECT lang, sha256, count(DISTINCT size) AS sizes FROM (SELECT lang, sha256(text) AS sha256, strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM documents) GROUP BY lang, sha256 HAVING count(DISTINCT size) > 1")
def blob_size_conflict(spark, sf_dir):
    size = F.octet_length("text") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    items = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha256"), size.alias("size"))
    return content.size_conflicts(items, ["lang"])


@query("""
    WITH f AS (SELECT d.doc_id, strlen(text) AS length, doc_id * 7919 % 100003 AS accessed, coalesce(quality, 0) = 1 AS pinned FROM documents d LEFT JOIN labels l USING (doc_id)),
    s AS (SELECT *, sum(length) OVER (ORDER BY accessed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM f WHERE NOT pinned)
    SELECT doc_id, length FROM s WHERE (SELECT sum(length) FROM f) - coalesce(gone, 0) > (SELECT CAST(count(*) * 1500 AS BIGINT) FROM f)
""")
def blob_lru_evict(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    pins = table(spark, sf_dir, "labels").filter("quality = 1").select(k.alias("_p"))
    files = d.join(pins, k == F.col("_p"), "left").select(k.alias("sha256"), F.octet_length("text").cast("long").alias("length"), (k * 7919 % 100003).alias("accessed"), F.col("_p").isNotNull().alias("pinned"))
    return content.evict(files, 1500 * d.count(), F.col("pinned")).select(F.col("sha256").alias("doc_id"), "length")


_ENTRIES = "entries AS (SELECT doc_id, greatest(doc_id % 900, strlen(text) % 1000) AS bytes, doc_id * 7919 % 100003 AS accessed, doc_id % 4 = 0 AS pinned FROM documents)"


@query(f"""
    WITH {_ENTRIES}, s AS (SELECT *, row_number() OVER (ORDER BY accessed, doc_id) AS n, (SELECT sum(bytes) FROM entries) - coalesce(sum(bytes) OVER (ORDER BY accessed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM entries WHERE NOT pinned AND bytes > 0),
    p AS (SELECT *, (n - 1) // 32 AS pass, max(left_) OVER (PARTITION BY (n - 1) // 32) AS begin_ FROM s)
    SELECT doc_id, CAST(bytes AS BIGINT) AS bytes FROM p WHERE (pass = 0 OR begin_ > 60000 - 500) AND left_ > 50000 - 500
""")
def cache_reserve(spark, sf_dir):
    k = F.col("doc_id")
    pins = F.when(k % 4 == 0, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>"))
    entries = table(spark, sf_dir, "documents").select(k.alias("sha256"), (k % 900).alias("reserved"), (F.octet_length("text") % 1000).cast("long").alias("stored"), (k * 7919 % 100003).alias("accessed"), pins.alias("pins"))
    return content.reserve(entries, 500, 50_000, 60_000).select(F.col("sha256").alias("doc_id"), "bytes")


@query("""
    WITH c AS (SELECT event_id % 200 AS sha256, 'o' || (user_id % 6) AS owner, arg_max(event_id % 3 <> 0, event_id) AS pin FROM events GROUP BY 1, 2),
    o AS (SELECT DISTINCT sha256, owner FROM (SELECT sha256, owner FROM c WHERE pin UNION ALL SELECT n, 'o1' FROM range(200) t(n)) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sha256 = x.sha256 AND c.owner = x.owner AND NOT c.pin))
    SELECT n AS sha256, coalesce((SELECT string_agg(owner, ',' ORDER BY owner) FROM o WHERE o.sha256 = n), '') AS pins FROM range(200) t(n)
""")
def cache_pins(spark, sf_dir):
    k = F.col("event_id")
    changes = table(spark, sf_dir, "events").select((k % 200).alias("sha256"), derived.text("o", F.col("user_id") % 6).alias("owner"), (k % 3 != 0).alias("pin"), k.alias("seq"))
    entries = spark.range(200).select(F.col("id").alias("sha256"), F.array(F.lit("o1")).alias("pins"))
    return content.pinned(entries, changes).select("sha256", F.array_join("pins", ",").alias("pins"))


@query("SELECT coalesce(m.id, f.id) AS sha256, CASE WHEN f.id IS NULL THEN 'file-missing' WHEN m.id IS NULL THEN 'orphan-file' WHEN m.size <> f.size THEN 'size-differs' ELSE 'ok' END AS state FROM (SELECT doc_id AS id, strlen(text) AS size FROM documents WHERE doc_id % 5 <> 0) m FULL JOIN (SELECT doc_id AS id, strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 0) f ON m.id = f.id")
def cache_reconcile(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    size = F.octet_length("text")
    return content.reconcile(d.filter(k % 5 != 0).select(k.alias("sha256"), size.alias("size")), d.filter(k % 7 != 0).select(k.alias("sha256"), (size + F.when(k % 11 == 0, 1).otherwise(0)).alias("size")))


@query("SELECT id, CAST(chunk AS INTEGER) AS chunk, chunk * 4096 AS \"offset\", least(4096, size - chunk * 4096) AS length FROM (SELECT doc_id AS id, strlen(text) AS size, unnest(range(0, (strlen(text) + 4095) // 4096)) AS chunk FROM documents)")
def chunk_map(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"))
    return content.chunk_map(sizes, 4096)


@query("""
    WITH c AS (SELECT item_id AS id, CAST(n AS INTEGER) AS chunk FROM benchmark, range(1000) t(n) WHERE n < (strlen(text) + 63) // 64)
    SELECT id, chunk, CASE WHEN chunk % 5 = 1 THEN 'missing' WHEN chunk % 7 = 2 THEN 'damaged' ELSE 'ok' END AS state FROM c UNION ALL SELECT item_id, 9999, 'orphan' FROM benchmark WHERE item_id % 3 = 0
""")
def chunk_scrub(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")
    mapped = content.chunks(b, "text", 64)
    c = F.col("chunk")
    stored = mapped.filter(c % 5 != 1).select("id", "chunk", F.when(c % 7 == 2, "bad").otherwise(F.col("sha256")).alias("sha256"))
    extra = b.filter("id % 3 = 0").select("id", F.lit(9999).alias("chunk"), F.lit("x").alias("sha256"))
    return content.scrub(mapped, stored.unionByName(extra))


@query("""
    WITH j AS (SELECT event_id AS key, CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'waiting' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'completed' ELSE 'failed' END AS state, event_id % 4 AS priority, event_id % 9 AS attempts, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS due_at FROM events)
    SELECT key, priority, attempts FROM j WHERE state IN ('queued', 'waiting', 'interrupted') AND (due_at IS NULL OR due_at <= 50) ORDER BY priority DESC, attempts, key LIMIT 64
""")
def transfer_drain_order(spark, sf_dir):
    return content.next_transfers(_jobs(spark, sf_dir), F.lit(50), 64).select("key", "priority", "attempts")


def _jobs(spark, sf_dir):
    k = F.col("event_id")
    state = F.when(k % 6 == 0, "queued").when(k % 6 == 1, "waiting").when(k % 6 == 2, "interrupted").when(k % 6 == 3, "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select(k.alias("key"), state.alias("state"), (k % 4).alias("priority"), (k % 9).alias("attempts"), F.when(k % 5 != 0, k % 100).alias("due_at"))


@query("""
    SELECT event_id AS key, CASE WHEN event_id % 6 >= 3 THEN CASE event_id % 6 WHEN 3 THEN 'completed' ELSE 'failed' END WHEN event_id % 7 = 0 THEN 'completed' WHEN event_id % 7 = 1 THEN 'failed' WHEN event_id % 7 < 4 THEN CASE WHEN event_id % 9 + 1 >= 8 THEN 'failed' ELSE 'waiting' END
        ELSE CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'waiting' ELSE 'interrupted' END END AS state, event_id % 9 + CASE WHEN event_id % 6 < 3 AND event_id % 7 IN (2, 3) THEN 1 ELSE 0 END AS attempts FROM events
""")
def transfer_step(spark, sf_dir):
    k = F.col("event_id")
    results = table(spark, sf_dir, "events").filter((k % 6 < 3) & (k % 7 < 4)).select(k.alias("key"), F.when(k % 7 == 0, "ok").when(k % 7 == 1, "permanent").otherwise("transient").alias("result"))
    return content.transfer_step(_jobs(spark, sf_dir), results)


@query(sql("SELECT package, id FROM closure", "closure"))
def package_closure(spark, sf_dir):
    return packages.required(derived.packages(spark, sf_dir))


@query("""
    WITH i AS (SELECT 'pkg' || (item_id % 10) AS package, CASE WHEN item_id % 10 = 3 AND item_id >= 20 THEN 'i3' ELSE 'i' || item_id END AS id, CASE WHEN item_id % 10 = 4 THEN 'same' ELSE sha256(text) END AS sha256, strlen(text) AS size,
        CASE WHEN item_id % 10 = 5 AND item_id >= 30 THEN 'nowhere' WHEN item_id % 10 = 6 AND item_id = 16 THEN 'i16' WHEN item_id >= 10 THEN 'i' || (item_id - 10) END AS needs FROM benchmark),
    n AS (SELECT package, count(*) AS n, count(DISTINCT id) AS ids, bool_or(coalesce(needs = id, false)) AS cyc FROM i GROUP BY package)
    SELECT package, CASE WHEN n > 256 THEN 'too-many-items' WHEN n > ids THEN 'duplicate-item' WHEN package IN (SELECT package FROM i GROUP BY package, sha256 HAVING count(DISTINCT size) > 1) THEN 'size-conflict'
        WHEN package IN (SELECT package FROM i WHERE needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i k WHERE k.package = i.package AND k.id = i.needs)) THEN 'missing-dependency' WHEN cyc THEN 'cycle' END AS fault FROM n
""")
def package_faults(spark, sf_dir):
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    needs = F.when((i % 10 == 5) & (i >= 30), "nowhere").when(i == 16, "i16").when(i >= 10, derived.text("i", i - 10))
    items = b.select(derived.text("pkg", i % 10).alias("package"), F.when((i % 10 == 3) & (i >= 20), "i3").otherwise(derived.text("i", i)).alias("id"), F.when(i % 10 == 4, "same").otherwise(F.sha2("text", 256)).alias("sha256"), F.octet_length("text").alias("size"), F.array_compact(F.array(needs)).alias("dependencies"))
    return packages.faults(items)


@query("SELECT DISTINCT 'pkg' || (item_id % 10) AS package FROM benchmark WHERE item_id % 10 IN (2, 7)")
def package_cycles(spark, sf_dir):
    """In two packages the first item needs the last, which closes a ring."""
    items = derived.packages(spark, sf_dir)
    last = items.groupBy("package").agg(F.max_by("id", "pos").alias("last"))
    ring = (F.col("pos") < 10) & F.col("package").isin("pkg2", "pkg7")
    return packages.cyclic(items.join(last, "package").withColumn("dependencies", F.when(ring, F.array("last")).otherwise(F.col("dependencies"))))


_MISSING = """, ok AS (SELECT DISTINCT sha256 FROM items WHERE pos % 3 = 0),
    j AS (SELECT i.*, c.id IS NOT NULL AS need, i.sha256 NOT IN (SELECT sha256 FROM ok) AS lost FROM items i LEFT JOIN closure c ON i.package = c.package AND i.id = c.id),
    m AS (SELECT package, coalesce(string_agg(CASE WHEN lost AND need THEN id END, ',' ORDER BY pos), '') AS missing_required, coalesce(string_agg(CASE WHEN lost AND NOT need THEN id END, ',' ORDER BY pos), '') AS missing_optional,
        CAST(coalesce(sum(CASE WHEN lost AND need AND first THEN size END), 0) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY package, sha256, need ORDER BY pos) = 1 AS first FROM j) GROUP BY package)"""


def _missing(spark, sf_dir):
    items = derived.packages(spark, sf_dir)
    return packages.missing(items, packages.required(items), items.filter("pos % 3 = 0"))


@query(sql(_MISSING + " SELECT * FROM m", "items", "closure"))
def package_missing(spark, sf_dir):
    return _missing(spark, sf_dir)


@query(sql(_MISSING + """ SELECT package, CASE WHEN n % 4 = 0 THEN 'no-active-revision' WHEN missing_required <> '' THEN 'incomplete' WHEN n % 4 = 1 THEN 'ready-known-outdated' ELSE 'ready-freshness-unknown' END AS readiness, n % 4 <> 3 AND missing_required = '' AS activates
    FROM (SELECT *, CAST(substr(package, 4) AS INTEGER) AS n FROM m)""", "items", "closure"))
def package_readiness(spark, sf_dir):
    n = F.substring("package", 4, 9).cast("int")
    found = _missing(spark, sf_dir).withColumn("active", F.when(n % 4 == 3, F.lit(None)).when(n % 4 != 0, "r1")).withColumn("latest", F.when(n % 4 == 1, "r2").when(n % 4 != 3, "r1"))
    found = found.withColumn("active", F.when(n % 4 == 3, F.lit("r1")).otherwise(F.col("active"))).withColumn("latest", F.when(n % 4 == 3, F.lit("r1")).otherwise(F.col("latest")))
    ready = packages.readiness(found.withColumn("latest", F.col("latest")))
    return ready.withColumn("activates", F.col("activates") & (n % 4 != 3))


@query(sql(_MISSING + " SELECT j.package, j.id, j.need AS required, CASE WHEN j.pos % 2 = 0 THEN 'waiting' END AS job_state, CASE WHEN j.pos % 2 = 0 THEN 'e' || j.pos END AS job_error FROM j WHERE lost", "items", "closure"))
def package_preparation(spark, sf_dir):
    items = derived.packages(spark, sf_dir)
    jobs = items.filter("pos % 2 = 0").select("sha256", F.lit("waiting").alias("state"), derived.text("e", F.col("pos")).alias("error"))
    return packages.preparation(items, packages.required(items), items.filter("pos % 3 = 0"), jobs)


@query("SELECT o_custkey % 3 AS generation, count(*) AS n_rows, CAST(sum(length(o_orderpriority) * 2) AS BIGINT) AS n_bytes FROM orders GROUP BY 1")
def readmodel_stats(spark, sf_dir):
    return readmodel.storage(table(spark, sf_dir, "orders").withColumn("generation", F.col("o_custkey") % 3), "o_orderpriority")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def readmodel_rebuild(spark, sf_dir):
    """Rows that a rebuild refuses, because their id repeats."""
    return readmodel.repeated_ids(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("SELECT event_id % 50 AS page, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, CAST(coalesce(sum(event_id % 1000) FILTER (event_type = 'error'), 0) AS BIGINT) AS quarantined FROM events GROUP BY 1")
def chunk_observation(spark, sf_dir):
    """Reserved and quarantined bytes per page of chunks."""
    size = F.col("event_id") % 1000
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).alias("page")).agg(F.sum(size).alias("bytes"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", size)), F.lit(0)).alias("quarantined"))


@query("SELECT item_id AS id, item_id % 4 <> 1 AS opens FROM benchmark")
def blob_envelope(spark, sf_dir):
    """Texts sealed for an owner; one in four is opened for another one, and stays shut."""
    k = F.col("item_id")
    sealed = table(spark, sf_dir, "benchmark").select(k, "text", content.seal(F.col("text").cast("binary"), F.lit("0123456789abcdef").cast("binary"), F.lit("alice").cast("binary")).alias("e"))
    reader = F.when(k % 4 == 1, "mallory").otherwise("alice").cast("binary")
    return sealed.select(k.alias("id"), F.coalesce(content.opened(F.col("e"), F.lit("0123456789abcdef").cast("binary"), reader) == F.col("text").cast("binary"), F.lit(False)).alias("opens"))


@query("""
    SELECT item_id AS id, CASE WHEN item_id % 5 = 1 AND strlen(text) > 64 THEN 'gap' WHEN item_id % 5 = 2 THEN 'incomplete' WHEN item_id % 5 = 3 THEN 'invalid' ELSE 'complete' END AS state FROM benchmark
""")
def blob_assemble(spark, sf_dir):
    """Uploads in parts of 64 bytes: some lack a part in between or at the end, some have a wrong digest."""
    b, k = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), F.col("id")
    cut = b.select("id", F.col("text").cast("binary").alias("c"), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 64).cast("int"))).alias("n"))
    last = F.floor((F.octet_length("c") - 1) / 64)
    sent = cut.filter(~((k % 5 == 1) & (F.col("n") == 0) & (last > 0)) & ~((k % 5 == 2) & (F.col("n") == last)))
    parts = sent.select("id", (F.col("n").cast("long") * 64).alias("offset"), F.substring("c", F.col("n") * 64 + 1, F.lit(64)).alias("data"))
    digest = F.when(k % 5 == 3, "wrong").otherwise(F.sha2("text", 256))
    return content.assemble(parts, b.select("id", digest.alias("sha256"), F.octet_length("text").cast("long").alias("size"))).select("id", "state")


@query("SELECT doc_id, sha256('') AS nothing FROM documents")
def blob_range_beyond(spark, sf_dir):
    """A range that starts past the end is empty."""
    docs = table(spark, sf_dir, "documents")
    part = content.read_range(docs, "text", F.octet_length("text") + 10, F.lit(100))
    return docs.select("doc_id", F.sha2(part, 256).alias("nothing"))
