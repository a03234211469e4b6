"""Queries over what stores hold: exported browser records, backups of an authority, generations of read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import feed, readmodel, replica
from tidemark.plans.registry import query
from tidemark.sources import derived, stores
from tidemark.sources.derived import sql
from tidemark.sources.scratch import scratch
from tidemark.sources.tables import table


@query(sql("SELECT id, current, base, base_version + 9007199254740993 AS base_version, is_dirty, local_revision, pending_op, observed_version, generation, missing FROM records", "records"))
def flat_records_import(spark, sf_dir):
    """Records of a browser store, which writes 64-bit numbers as text, some of them beyond what a double holds."""
    records = derived.records(spark, sf_dir)
    numbers = [c.split()[0] for c in replica.RECORD.split(", ") if c.endswith("BIGINT")]
    exported = records.withColumn("base_version", F.col("base_version") + 9007199254740993).withColumns({c: F.col(c).cast("string") for c in numbers if c != "base_version"}).withColumn("base_version", F.col("base_version").cast("string"))
    found = stores.flat_records(exported.drop("pending_group", "group_id"))
    return found.select("id", "current", "base", "base_version", "is_dirty", "local_revision", "pending_op", "observed_version", "generation", "missing")


@query(sql("""
    SELECT f.scope, greatest(f.head, 1000) AS head, 'restored' AS epoch, (SELECT count(*) FROM authority a WHERE a.scope = f.scope) AS documents, (SELECT max(version) FROM authority a WHERE a.scope = f.scope AND NOT deleted) AS newest FROM feeds f
""", "authority", "feeds"))  # fmt: skip
def backup_restored(spark, sf_dir):
    """An authority written to a backup and read back: its feeds go on under a new epoch, at or above the floor."""
    authority, path = derived.authority_documents(spark, sf_dir), f"{scratch(spark, 'backup')}/backup"
    heads = feed.heads(authority).withColumn("epoch", F.lit("first"))
    readmodel.backup({"feeds": heads, "documents": authority}, path)
    back = readmodel.restore(spark, path, ["feeds", "documents"], 1000, "restored")
    held = back["documents"].groupBy(F.col("scope").alias("_s")).agg(F.count(F.lit(1)).alias("documents"), F.max(F.when(~F.col("deleted"), F.col("version"))).alias("newest"))
    return back["feeds"].join(held, F.col("scope") == F.col("_s")).select("scope", F.col("head").cast("long").alias("head"), "epoch", "documents", "newest")


@query("""
    SELECT g AS generation, state, CASE WHEN state <> 'collected' THEN (SELECT count(*) FROM part WHERE p_size % 3 >= n) END AS n_rows FROM (VALUES ('g0', 0, 'collected'), ('g1', 1, 'retired'), ('g2', 2, 'active')) t(g, n, state)
""")
def readmodel_generations(spark, sf_dir):
    """Three generations of a read model, built one after the other: the last is active, the first collected, the second retired."""
    path = f"{scratch(spark, 'model')}/model"
    parts = table(spark, sf_dir, "part").select(derived.text("p", F.col("p_partkey")).alias("id"), "p_size")
    for n in range(3):
        readmodel.rebuild(parts.filter(F.col("p_size") % 3 >= n), path, f"g{n}")
    gone = readmodel.collect_retired(spark, path, most=1)
    left = [g for g in readmodel.retired(spark, path) if g not in gone]
    states = spark.createDataFrame([(g, "collected") for g in gone] + [(g, "retired") for g in left], "generation string, state string")
    kept = spark.read.parquet(*(f"{path}/generations/{g}" for g in left)).groupBy(F.lit(left[0]).alias("_g")).agg(F.count(F.lit(1)).alias("n_rows"))
    live = readmodel.active(spark, path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("g2").alias("generation"), F.lit("active").alias("state"), "n_rows")
    return states.join(kept, F.col("generation") == F.col("_g"), "left").select("generation", "state", "n_rows").unionByName(live)
