"""Server-side publication: upserts, deletes, replacing a scope, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.numbering import lot_of, number_rows


def publish(rows: DataFrame, documents: DataFrame, feeds: DataFrame, content: str = "payload") -> DataFrame:
    """Upsert: rows (scope, id, pos, content, deleted) against documents; unchanged content makes no version.

    A delete of what doesn't exist is `none`, of a tombstone `unchanged`. Content excludes the timestamp. Repeated
    ids in rows are to be resolved by the caller. A row without a scope or an id is `invalid`; one without a position comes first.
    Returns scope, id, action, version.
    """
    d = documents.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col(content).alias("_c"), F.col("deleted").alias("_d"), F.col("version").alias("_v"))
    joined = rows.join(d, (F.col("scope") == F.col("_s")) & (F.col("id") == F.col("_i")), "left")
    action = (
        F.when(F.col("scope").isNull() | F.col("id").isNull(), "invalid")
        .when(F.col("deleted") & F.col("_i").isNull(), "none")
        .when(F.col("deleted") & F.col("_d"), "unchanged")
        .when(F.col("deleted"), "deleted")
        .when(~F.coalesce("_d", F.lit(False)) & F.col("_c").eqNullSafe(F.col(content)) & F.col("_i").isNotNull(), "unchanged")
        .otherwise("written")
    )
    decided = joined.withColumn("action", action)
    fresh = number_rows(decided.filter(F.col("action").isin("written", "deleted")), ["scope"], ["pos", "id"], lot_of(F.col("pos")), "_n")
    versioned = fresh.join(feeds.select("scope", "head"), "scope", "left").select("scope", "id", "action", (F.coalesce("head", F.lit(0)) + F.col("_n")).alias("version"))
    return versioned.unionByName(decided.filter(~F.col("action").isin("written", "deleted")).select("scope", "id", "action", F.col("_v").alias("version")))


def replace_scope(listed: DataFrame, documents: DataFrame, content: str = "payload") -> DataFrame:
    """What replacing each scope's documents by the listed ones does: (scope, id, action) of every document concerned.

    Listed ids must be distinct within a scope. Live documents that aren't listed are deleted.
    """
    a = listed.select("scope", "id", F.col(content).alias("_new"), F.lit(True).alias("_listed"))
    d = documents.filter(~F.col("deleted")).select("scope", "id", F.col(content).alias("_old"), F.lit(True).alias("_live"))
    both = a.join(d, ["scope", "id"], "full_outer")
    action = F.when(F.col("_listed").isNull(), "deleted").when(F.col("_live") & F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("written")
    return both.select("scope", "id", action.alias("action"))


def fan_out(rows: DataFrame, scopes: str) -> DataFrame:
    """One copy of a row for each distinct scope it names."""
    return rows.withColumn("scope", F.explode(F.array_distinct(scopes))).drop(scopes)


def drain(outbox: DataFrame, now, limit: int) -> DataFrame:
    """The next rows of an outbox: not poisoned and due, oldest request first."""
    return outbox.filter(~F.col("poisoned") & (F.col("retry_at") <= now)).orderBy("requested_at", "tenant", "id").limit(limit)


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Resolve repeated ids of a list before publishing it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")
