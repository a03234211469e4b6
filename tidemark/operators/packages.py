"""Packages of blobs: manifests with dependencies, what is missing, readiness and activation.

Items: package, pos, id, sha256, size, required, dependencies (array of ids). A manifest has at most 256 items, so a
package's graph is a map in one row, and closures are expressions over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS = 256


def edges(items: DataFrame) -> DataFrame:
    return items.select("package", "id", F.explode("dependencies").alias("needs"))


def reach(links: Column, seed: Column, steps: Column) -> Column:
    """Ids reachable from the seed over a map of id to ids, the seed's own included only if it is reached.

    Goes on from what each step found, so an edge is followed once and a cycle ends.
    """
    none = F.array().cast("array<string>")

    def step(s: Column, _: Column) -> Column:
        beyond = F.flatten(F.transform(s["new"], lambda i: F.coalesce(F.try_element_at(links, i), none)))
        new = F.array_except(beyond, s["seen"])
        return F.struct(F.concat(s["seen"], new).alias("seen"), new.alias("new"))

    start = F.struct(none.alias("seen"), seed.alias("new"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["seen"])


def _graphs(links: DataFrame) -> DataFrame:
    """package and its map of dependencies: at most MOST_ITEMS entries."""
    by_id = links.groupBy("package", "id").agg(F.collect_set("needs").alias("needs"))
    return by_id.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("id", "needs"))).alias("links"))


def closure(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(package, id) reachable from the roots, these included. Packages are independent, each a row."""
    seeds = roots.groupBy("package").agg(F.collect_set("id").alias("seed"))
    joined = seeds.join(_graphs(links), "package", "left")
    known = F.coalesce("links", F.expr("map()").cast("map<string,array<string>>"))
    found = F.array_union("seed", reach(known, F.col("seed"), F.size(known) + 1))
    return joined.select("package", F.explode(found).alias("id"))


def required(items: DataFrame) -> DataFrame:
    return closure(items.filter("required"), edges(items))


def faults(items: DataFrame) -> DataFrame:
    """Faults of manifests: too many items, repeated ids, unknown dependencies, one digest with two sizes, self-cycles."""
    n = items.groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.bool_or(F.array_contains("dependencies", F.col("id"))).alias("cycle"))
    known = items.select("package", F.col("id").alias("needs")).distinct()
    lost = edges(items).join(known, ["package", "needs"], "left_anti").select("package").distinct().withColumn("lost", F.lit(True))
    sizes = items.groupBy("package", "sha256").agg(F.countDistinct("size").alias("s")).filter("s > 1").select("package").distinct().withColumn("sizes", F.lit(True))
    joined = n.join(lost, "package", "left").join(sizes, "package", "left")
    fault = (
        F.when(F.col("n") > MOST_ITEMS, "too-many-items").when(F.col("n") > F.col("ids"), "duplicate-item").when(F.col("sizes"), "size-conflict")
        .when(F.col("lost"), "missing-dependency").when(F.col("cycle"), "cycle")
    )
    return joined.select("package", fault.alias("fault"))


def cyclic(items: DataFrame) -> DataFrame:
    """Packages in which some item reaches itself."""
    graph = _graphs(edges(items))
    loops = F.exists(F.map_keys("links"), lambda i: F.array_contains(reach(F.col("links"), F.array(i), F.size("links")), i))
    return graph.filter(loops).select("package")


def missing(items: DataFrame, needed: DataFrame, verified: DataFrame) -> DataFrame:
    """Per package: missing required and optional ids in manifest order, and the bytes of required content, each digest once."""
    joined = items.join(needed.select("package", "id", F.lit(True).alias("_need")), ["package", "id"], "left").join(verified.select("sha256").distinct().withColumn("_ok", F.lit(True)), "sha256", "left")
    first = F.row_number().over(Window.partitionBy("package", "sha256", "_need").orderBy("pos")) == 1
    marked = joined.withColumn("_lost", F.col("_ok").isNull()).withColumn("_need", F.coalesce("_need", F.lit(False))).withColumn("_first", first)
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "id")))), lambda x: x["id"]), ",")
    return marked.groupBy("package").agg(
        names(F.col("_lost") & F.col("_need")).alias("missing_required"), names(F.col("_lost") & ~F.col("_need")).alias("missing_optional"),
        F.coalesce(F.sum(F.when(F.col("_lost") & F.col("_need") & F.col("_first"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )


def readiness(packages: DataFrame) -> DataFrame:
    """packages: package, active, latest (revisions), missing_required (text)."""
    state = (
        F.when(F.col("active").isNull(), "no-active-revision").when(F.col("missing_required") != "", "incomplete")
        .when(~F.col("latest").eqNullSafe(F.col("active")), "ready-known-outdated").otherwise("ready-freshness-unknown")
    )
    return packages.select("package", state.alias("readiness"), (F.col("latest").isNotNull() & (F.col("missing_required") == "")).alias("activates"))


def preparation(items: DataFrame, needed: DataFrame, verified: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unavailable items with the state and error of their download, if there is one."""
    lost = items.join(verified.select("sha256").distinct(), "sha256", "left_anti")
    n = needed.select("package", "id", F.lit(True).alias("_need"))
    j = jobs.select(F.col("sha256").alias("_s"), F.col("state").alias("job_state"), F.col("error").alias("job_error"))
    joined = lost.join(n, ["package", "id"], "left").join(j, F.col("sha256") == F.col("_s"), "left")
    return joined.select("package", "id", F.coalesce("_need", F.lit(False)).alias("required"), "job_state", "job_error")
