"""Collections derived from the input tables, each with the same derivation in SQL.

A derivation is deterministic, so a query over it can be held against SQL. CTES has the SQL by name; the functions
here are the DataFrame forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import feed
from tidemark.operators.push import fingerprint
from tidemark.sources.tables import table

#: "Now" of the derived requests, in milliseconds.
NOW_MS = 1_800_000_000_000


def text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, id, version, deleted, updated_at, event_type, value, props: users as documents, events as their versions."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        text("s", F.col("user_id") % 4).alias("scope"), text("u", F.col("user_id")).alias("id"), (k + 1).alias("version"), (F.col("event_type") == "error").alias("deleted"),
        clock.encode(millis("ts"), F.lit(0), text("n", F.col("user_id") % 8)).alias("updated_at"), "event_type", "value", "props",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.latest(changelog(spark, sf_dir), ["scope", "id"])


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog's writes with their readers."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        text("s", F.col("user_id") % 4).alias("scope"), text("u", F.col("user_id")).alias("id"), (k + 1).alias("version"), (F.col("event_type") == "error").alias("deleted"),
        F.array_distinct(F.array(text("p", k % 3), text("p", k % 5))).alias("readers"),
    )


def authority_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, id, version, payload, deleted: customers, but for a third of them."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.filter(k % 3 != 0).select(text("s", k % 4).alias("scope"), text("c", k).alias("id"), k.alias("version"), F.col("c_name").alias("payload"), (k % 7 == 0).alias("deleted"))


def authority_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority_documents(spark, sf_dir).groupBy("scope").agg(F.max("version").alias("head")).withColumn("purged_through", F.floor(F.col("head") / 3).cast("long"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per scope, made of orders: every kind of fault, replay and group occurs."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    base = F.when(k % 4 == 0, c).when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, F.lit(1)).otherwise(c + 1000)
    group = F.when(k % 5 == 0, text("g", c % 400))
    ops = o.select(
        text("s", c % 4).alias("scope"), k.alias("pos"), F.when(k % 101 == 0, F.lit("")).otherwise(text("op", F.when(k % 97 == 0, k - 1).otherwise(k))).alias("operation_id"),
        text("c", c).alias("document_id"), F.when(k % 103 == 0, F.lit(0)).otherwise(base).cast("long").alias("base_version"), F.when(k % 107 == 0, F.lit("other")).otherwise(text("c", c)).alias("body_id"),
        clock.encode(F.when(k % 19 == 0, F.lit(NOW_MS + 300_001)).otherwise(millis("o_orderdate")), F.lit(0), text("n", c % 8)).alias("updated_at"), F.col("o_orderpriority").alias("payload"), group.alias("group"),
    )
    sizes = ops.filter(F.col("group").isNotNull()).groupBy(F.col("scope").alias("_s"), F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    size = F.when(F.col("group").isNull(), F.lit(0)).otherwise(F.col("_n") + F.when(F.col("pos") % 211 == 0, 1).otherwise(0)).cast("int")
    return ops.join(sizes, (F.col("scope") == F.col("_s")) & (F.col("group") == F.col("_g")), "left").withColumn("group_size", size).drop("_s", "_g", "_n")


def receipts(ops: DataFrame) -> DataFrame:
    """Receipts of earlier requests: resent operations, and ids used for others."""
    k = F.col("pos")
    kind = F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "conflict").otherwise("rejected")
    return ops.filter((k % 7 == 0) & (k % 101 != 0) & (k % 97 != 0)).select(
        "operation_id", F.when(k % 14 == 0, fingerprint()).otherwise(F.lit("other")).alias("fingerprint"), kind.alias("kind"),
        F.when(k % 3 != 2, k).alias("version"), F.when(k % 3 == 2, "forbidden").alias("error_code"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica records, made of orders."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    dirty = F.col("o_orderstatus") == "P"
    null = F.lit(None)
    return o.select(
        text("o", k).alias("id"), text("cur", k).alias("current"), F.when(k % 31 != 0, text("base", k)).alias("base"), F.when(k % 31 != 0, k).alias("base_version"), dirty.alias("is_dirty"),
        (k % 5 + 1).alias("local_revision"), F.when(dirty & (k % 2 == 0), text("op", k)).alias("pending_op"), F.when(dirty & (k % 2 == 0), k % 5 + F.when(k % 8 == 0, 0).otherwise(1)).cast("long").alias("pending_revision"),
        F.when(dirty & (k % 6 == 0), text("g", k % 40)).alias("pending_group"),
        F.when(dirty & (k % 13 == 0), F.when(k % 26 == 0, "group-failed").when(k % 39 == 0, "clock-skew").otherwise("invalid")).alias("rejection"),
        F.when(k % 10 == 0, text("obs", k)).alias("observed"), F.when(k % 10 == 0, k + F.when(k % 20 == 0, 5).otherwise(-5)).alias("observed_version"), (k % 3).alias("generation"), (k % 23 == 0).alias("missing"),
        F.when(k % 17 == 0, text("mine", k)).alias("conflict"), F.when(k % 17 == 0, k).alias("conflict_version"), F.when(dirty & (k % 6 == 0), text("g", k % 40)).otherwise(null).alias("group_id"),
    )


def remote_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pulled page for the records: newer, older and new documents."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    known = o.filter(k % 2 == 0).select(text("o", k).alias("id"), text("srv", k).alias("document"), (k + k % 4 - 1).alias("version"))
    return known.unionByName(o.filter(k % 29 == 0).select(text("new", k).alias("id"), text("srv", k).alias("document"), k.alias("version")))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ten packages made of the benchmark's texts; each item needs the one ten before it."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    return b.select(
        text("pkg", i % 10).alias("package"), i.alias("pos"), text("i", i).alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), (i % 4 == 0).alias("required"),
        F.when(i >= 10, F.array(text("i", i - 10))).otherwise(F.array().cast("array<string>")).alias("dependencies"), "text",
    )


CTES: dict[str, str] = {
    "changelog": """SELECT 's' || (user_id % 4) AS scope, 'u' || user_id AS id, event_id + 1 AS version, event_type = 'error' AS deleted,
        lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 15, '0') || ':000000:n' || (user_id % 8) AS updated_at, event_type, value, props FROM events""",
    "docs": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY version DESC) AS rn FROM changelog) WHERE rn = 1""",
    "authority": """SELECT 's' || (c_custkey % 4) AS scope, 'c' || c_custkey AS id, c_custkey AS version, c_name AS payload, c_custkey % 7 = 0 AS deleted FROM customer WHERE c_custkey % 3 <> 0""",
    "feeds": """SELECT scope, max(version) AS head, max(version) // 3 AS purged_through FROM authority GROUP BY scope""",
    "ops0": f"""SELECT 's' || (o_custkey % 4) AS scope, o_orderkey AS pos, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE 'op' || CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END END AS operation_id,
        'c' || o_custkey AS document_id, CASE WHEN o_orderkey % 103 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN 1 ELSE o_custkey + 1000 END AS base_version,
        CASE WHEN o_orderkey % 107 = 0 THEN 'other' ELSE 'c' || o_custkey END AS body_id, CASE WHEN o_orderkey % 19 = 0 THEN {NOW_MS + 300_001} ELSE epoch_us(o_orderdate) // 1000 END AS wall,
        o_orderpriority AS payload, CASE WHEN o_orderkey % 5 = 0 THEN 'g' || (o_custkey % 400) END AS grp FROM orders""",
    "ops": """SELECT *, CASE WHEN grp IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY scope, grp) + CASE WHEN pos % 211 = 0 THEN 1 ELSE 0 END END AS group_size FROM ops0""",
    "printed": """SELECT *, upper(sha256(length(document_id) || ':' || document_id || '|' || coalesce(CAST(base_version AS VARCHAR), '') || '|' || coalesce(grp, '') || '|' || group_size || '|' || coalesce(payload, ''))) AS fingerprint FROM ops""",
    "receipts": """SELECT operation_id AS r_id, CASE WHEN pos % 14 = 0 THEN fingerprint ELSE 'other' END AS r_print, CASE pos % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'conflict' ELSE 'rejected' END AS r_kind,
        CASE WHEN pos % 3 <> 2 THEN pos END AS r_version, CASE WHEN pos % 3 = 2 THEN 'forbidden' END AS r_code FROM printed WHERE pos % 7 = 0 AND pos % 101 <> 0 AND pos % 97 <> 0""",
    "marked0": """SELECT *, grp IS NOT NULL AS grouped, CASE WHEN grp IS NULL THEN pos ELSE min(pos) OVER (PARTITION BY scope, grp) END AS first_pos,
        (operation_id = '' OR body_id <> document_id OR coalesce(base_version < 1, false)) AS malformed0 FROM printed""",
    "marked1": """SELECT *, malformed0 OR row_number() OVER (PARTITION BY scope, document_id, malformed0 ORDER BY grouped, first_pos, pos) > 1 AS malformed FROM marked0""",
    "marked2": """SELECT *, malformed OR (grouped AND bool_or(malformed OR group_size <> n) OVER (PARTITION BY scope, grp)) AS invalid
        FROM (SELECT *, count(*) OVER (PARTITION BY scope, grp) AS n FROM marked1)""",
    "marked": """SELECT *, (grouped, first_pos) <> first_value((grouped, first_pos)) OVER (PARTITION BY scope, operation_id, invalid ORDER BY grouped, first_pos, pos) AS used_before FROM marked2""",
    "evaluated": f"""SELECT m.*, NOT invalid AND coalesce(r_print = fingerprint, false) AS duplicate, a.version AS current_version, f.head, r_version,
        CASE WHEN invalid THEN 'rejected' WHEN r_print = fingerprint THEN r_kind WHEN r_id IS NOT NULL OR used_before THEN 'rejected' WHEN wall > {NOW_MS + 300_000} THEN 'rejected'
            WHEN a.id IS NULL AND base_version <= f.purged_through THEN 'rejected' WHEN pos % 41 = 0 THEN 'rejected' WHEN pos % 43 = 0 THEN 'rejected'
            WHEN a.id IS NOT NULL AND base_version IS DISTINCT FROM a.version THEN 'conflict' WHEN pos % 47 = 0 THEN 'retry-later' ELSE 'accepted' END AS kind0,
        CASE WHEN invalid THEN 'invalid' WHEN r_print = fingerprint THEN r_code WHEN r_id IS NOT NULL OR used_before THEN 'operation-id-reused' WHEN wall > {NOW_MS + 300_000} THEN 'clock-skew'
            WHEN a.id IS NULL AND base_version <= f.purged_through THEN 'base-expired' WHEN pos % 41 = 0 THEN 'forbidden' WHEN pos % 43 = 0 THEN 'too-long'
            WHEN a.id IS NOT NULL AND base_version IS DISTINCT FROM a.version THEN NULL WHEN pos % 47 = 0 THEN 'busy' END AS code0
        FROM marked m LEFT JOIN receipts r ON m.operation_id = r.r_id LEFT JOIN authority a ON m.scope = a.scope AND m.document_id = a.id LEFT JOIN feeds f ON m.scope = f.scope""",
    "settled": """SELECT *, CASE WHEN waits THEN 'retry-later' ELSE kind0 END AS kind, CASE WHEN waits THEN 'group-aborted' ELSE code0 END AS error_code FROM
        (SELECT *, grouped AND kind0 = 'accepted' AND NOT duplicate AND NOT bool_and(kind0 = 'accepted') OVER (PARTITION BY scope, grp) AS waits FROM evaluated)""",
    "pushed": """SELECT *, CASE WHEN duplicate THEN r_version WHEN kind = 'conflict' THEN current_version WHEN kind = 'accepted' THEN head
            + sum(CASE WHEN kind = 'accepted' AND NOT duplicate THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY grouped, first_pos, pos) END AS version FROM settled""",
    "records": """SELECT o_orderkey AS k, 'o' || o_orderkey AS id, 'cur' || o_orderkey AS current, CASE WHEN o_orderkey % 31 <> 0 THEN 'base' || o_orderkey END AS base, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderkey END AS base_version,
        o_orderstatus = 'P' AS is_dirty, o_orderkey % 5 + 1 AS local_revision, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'op' || o_orderkey END AS pending_op,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_orderkey % 5 + CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 1 END END AS pending_revision,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 6 = 0 THEN 'g' || (o_orderkey % 40) END AS pending_group,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 13 = 0 THEN CASE WHEN o_orderkey % 26 = 0 THEN 'group-failed' WHEN o_orderkey % 39 = 0 THEN 'clock-skew' ELSE 'invalid' END END AS rejection,
        CASE WHEN o_orderkey % 10 = 0 THEN 'obs' || o_orderkey END AS observed, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 5 ELSE -5 END END AS observed_version,
        o_orderkey % 3 AS generation, o_orderkey % 23 = 0 AS missing, CASE WHEN o_orderkey % 17 = 0 THEN 'mine' || o_orderkey END AS conflict, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey END AS conflict_version,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 6 = 0 THEN 'g' || (o_orderkey % 40) END AS group_id FROM orders""",
    "changes": """SELECT 'o' || o_orderkey AS c_id, 'srv' || o_orderkey AS c_doc, o_orderkey + o_orderkey % 4 - 1 AS c_version FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'new' || o_orderkey, 'srv' || o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 29 = 0""",
    "items": """SELECT 'pkg' || (item_id % 10) AS package, item_id AS pos, 'i' || item_id AS id, sha256(text) AS sha256, strlen(text) AS size, item_id % 4 = 0 AS required,
        CASE WHEN item_id >= 10 THEN 'i' || (item_id - 10) END AS needs FROM benchmark""",
    "closure": """SELECT package, id FROM items WHERE required UNION SELECT i.package, i.needs FROM closure c JOIN items i ON i.package = c.package AND i.id = c.id WHERE i.needs IS NOT NULL""",
}

#: What each derivation builds on.
NEEDS: dict[str, tuple[str, ...]] = {
    "docs": ("changelog",), "feeds": ("authority",), "ops": ("ops0",), "printed": ("ops",), "receipts": ("printed",), "marked0": ("printed",), "marked1": ("marked0",), "marked2": ("marked1",), "marked": ("marked2",),
    "evaluated": ("marked", "receipts", "authority", "feeds"), "settled": ("evaluated",), "pushed": ("settled",), "closure": ("items",),
}


def sql(body: str, *names: str) -> str:
    """body with the derivations it names, and what those need, as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = "WITH RECURSIVE" if "closure" in order else "WITH"
    tables = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    join = ",\n" if body.lstrip().startswith(",") else "\n"
    return f"{head} {tables}{join}{body.lstrip().lstrip(',')}"
