"""The change feed: compaction to the latest version, pages, heads and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import id_order, id_valid
from tidemark.operators.numbering import lot_of, number_rows, running


def latest(changelog: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row of the greatest version per key. Partial aggregation keeps one row a key and task before the shuffle.

    Each column is an aggregate of its own, so those that a query doesn't use are neither read nor shuffled, and fixed-width
    ones are aggregated by hash.
    """
    rest = [c for c in changelog.columns if c not in (*keys, version)]
    newest = changelog.groupBy(*keys).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in rest))
    return newest.select(*changelog.columns)


def page_with_facts(window: DataFrame, since: int, limit: int, ok: Column, version: str = "version") -> DataFrame:
    """The rows of a page that are ok, each with the page's `has_more` and `checkpoint`; without any, one row of nulls with these.

    window: the limit + 1 rows after the position at most. A row of nulls is added that comes last and stays only where no other
    does; the facts are folds over all of them, so payloads never meet in one row and a page may be of any size.
    """
    own = window.columns
    rows = window.select(*own, F.coalesce(ok, F.lit(False)).alias("_ok"), F.lit(False).alias("_end"))
    end = window.sparkSession.range(1).select(*(F.lit(None).cast(window.schema[c].dataType).alias(c) for c in own), F.lit(False).alias("_ok"), F.lit(True).alias("_end"))
    by_place, whole = Window.orderBy("_end", version), Window.orderBy("_end", version).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.unionByName(end).withColumn("_in", ~F.col("_end") & (F.row_number().over(by_place) <= limit))
    facts = {
        "has_more": F.count_if(~F.col("_end")).over(whole) > limit,
        "checkpoint": F.coalesce(F.max(F.when(F.col("_in"), F.col(version))).over(whole).cast("long"), F.lit(since).cast("long")),
        "_shown": F.count_if(F.col("_in") & F.col("_ok")).over(whole),
    }
    return placed.withColumns(facts).filter((F.col("_in") & F.col("_ok")) | (F.col("_end") & (F.col("_shown") == 0))).select(*own, "has_more", "checkpoint")


def pull_page(feed: DataFrame, since: int, limit: int, can_read: Column | None = None, version: str = "version") -> DataFrame:
    """One page after a position: the rows with `checkpoint` (where the next page starts) and `has_more`.

    The limit comes first and can_read after it, so a page may hold fewer rows and the checkpoint still advances past those that
    the caller may not read. A page without rows, or without any that may be read, is one row of nulls with the facts.
    """
    window = feed.filter(F.col(version) > since).orderBy(version).limit(limit + 1)
    return page_with_facts(window, since, limit, F.lit(True) if can_read is None else can_read, version)


def pages(feed: DataFrame, limit: int, scope: str = "scope", version: str = "version") -> DataFrame:
    """The whole feed with the page (from 0) of each row when pulled `limit` rows at a time."""
    numbered = number_rows(feed, [scope], [version], lot_of(F.col(version)))
    return numbered.withColumn("page", F.floor((F.col("number") - 1) / limit).cast("long")).drop("number")


def page_faults(headers: DataFrame, changes: DataFrame, removals: DataFrame, page: str, limit: int) -> DataFrame:
    """The first fault of each page a server sent, null if it is sound.

    headers: page, since (the checkpoint asked with), checkpoint, has_more; changes: page, id, version; removals: page, id.
    Removals count towards the limit, and none may repeat or stand beside a change of its id.
    """
    entries = changes.select(F.col(page).alias("_page"), "id", F.col("version").alias("v"), F.lit(True).alias("c")).unionByName(removals.select(F.col(page).alias("_page"), "id", F.lit(None).cast("long").alias("v"), F.lit(False).alias("c")))
    per_id = entries.groupBy("_page", "id").agg(F.count_if("c").alias("cs"), F.count_if(~F.col("c")).alias("rs"), F.bool_or(F.col("c") & (F.col("v").isNull() | (F.col("v") < 1))).alias("low"))
    bad = ~F.coalesce(id_valid(F.col("id")), F.lit(False))
    facts = per_id.groupBy("_page").agg(
        F.sum("cs").alias("n"), F.count(F.lit(1)).alias("ids"), F.bool_or(bad & (F.col("cs") > 0)).alias("bad_change"), F.bool_or("low").alias("low"), F.bool_or(F.col("cs") > 1).alias("twice"),
        F.bool_or(bad & (F.col("rs") > 0)).alias("bad_removal"), F.bool_or((F.col("rs") > 0) & (F.col("cs") > 0)).alias("both"), F.bool_or(F.col("rs") > 1).alias("again"),
    )
    fault = (
        F.when(F.col("n") > limit, "too-many").when(F.col("has_more") & F.col("checkpoint").eqNullSafe(F.col("since")), "no-progress").when(F.col("bad_change"), "invalid-id").when(F.col("low"), "invalid-version")
        .when(F.col("twice"), "duplicate-id").when(F.col("bad_removal"), "invalid-removal").when(F.col("both"), "changed-and-removed").when(F.col("again"), "repeated-removal").when(F.col("ids") > limit, "too-many")
    )
    return headers.join(facts, F.col(page) == F.col("_page"), "left").select(page, fault.alias("fault"))


def heads(changelog: DataFrame, scope: str = "scope", version: str = "version") -> DataFrame:
    return changelog.groupBy(scope).agg(F.max(version).alias("head"))


def horizon_as_of(samples: DataFrame, cutoff: Column, keys: list[str], at: str = "at", head: str = "head") -> DataFrame:
    """Feed head of the last sample at or before the cutoff, per key."""
    return samples.filter(F.col(at) <= cutoff).groupBy(*keys).agg(F.max_by(F.col(head), F.col(at)).alias("horizon"))


def as_of(probes: DataFrame, samples: DataFrame, keys: list[str], at: str, value: str, lot: Column, name: str) -> DataFrame:
    """probes with the value of the last sample of their keys at or before each one's own time; of samples at one time the greatest.

    Samples and probes are one sequence by time, in which a probe takes the last sample seen: a running maximum of (time, value),
    in lots of the time, so a key's history doesn't meet in one task and there is no join by range. lot: a number that
    doesn't decrease with `at`. A probe without a time, or before all samples, gets null.
    """
    own = F.struct(*(F.col(c) for c in probes.columns))
    asked = probes.select(*keys, F.col(at).alias("_at"), lot.alias("_l"), F.lit(None).cast(samples.schema[value].dataType).alias("_v"), F.lit(1).alias("_asked"), own.alias("_row"))
    seen = samples.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), lot.alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_asked"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    last = F.when(F.col("_asked") == 0, F.struct("_at", "_v"))
    found = running(seen.unionByName(asked), keys, ["_at", "_asked"], F.col("_l"), maxes={"_last": last}).filter("_asked = 1")
    return found.select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_last._v")).alias(name))


def purge_tombstones(documents: DataFrame, horizons: DataFrame, scope: str = "scope") -> DataFrame:
    """The documents that stay: tombstones at or below the horizon of their scope go."""
    joined = documents.join(horizons.select(F.col(scope).alias("_s"), F.col("horizon").alias("_h")), F.col(scope) == F.col("_s"), "left")
    return joined.filter(~(F.col("deleted") & (F.col("version") <= F.coalesce("_h", F.lit(0))))).drop("_s", "_h")


def purge_receipts(receipts: DataFrame, through: Column) -> DataFrame:
    """Accepted receipts up to a version go; conflicts and rejections stay."""
    return receipts.filter(~((F.col("kind") == "accepted") & (F.col("version") <= through)))


def retention_run(documents: DataFrame, receipts: DataFrame, access: DataFrame, feeds: DataFrame, samples: DataFrame, now: int, offline: int, keep_receipts: int | None = None) -> dict[str, DataFrame]:
    """documents, receipts, access, feeds and samples after a run that purges what is older than its horizon.

    feeds: scope, head, purged_through; samples: scope, at, head of earlier runs, to which this run adds one a feed. What was
    the head a horizon ago is old enough: tombstones up to it go with their access rows, and purged_through rises to it;
    accepted receipts go up to the head of their own horizon, which is never the shorter one. Of the samples, those
    that no later run can need go. now, at and the horizons are numbers of one unit.
    """
    keep = offline if keep_receipts is None else keep_receipts
    if offline <= 0 or keep < offline:
        raise ValueError("horizons are positive, and receipts stay at least as long as replicas may be offline")
    taken = samples.select("scope", "at", "head").unionByName(feeds.select("scope", F.lit(now).cast("long").alias("at"), "head"))
    as_of = lambda cutoff: F.max_by(F.when(F.col("at") <= cutoff, F.col("head")), F.when(F.col("at") <= cutoff, F.col("at")))
    per = taken.groupBy(F.col("scope").alias("_s")).agg(as_of(now - offline).alias("_tombstones"), as_of(now - keep).alias("_receipts"), F.max(F.when(F.col("at") <= now - keep, F.col("at"))).alias("_from"))
    raised = feeds.join(per, F.col("scope") == F.col("_s"), "left").withColumn("_through", F.least("_tombstones", "head"))  # a feed may have been restored to a lower head
    horizons = raised.select(F.col("scope").alias("_s"), F.col("_through").alias("_t"), F.col("_receipts").alias("_r"))
    beside = lambda rows: rows.join(horizons, F.col("scope") == F.col("_s"), "left")
    old = F.coalesce(F.col("deleted") & (F.col("version") <= F.col("_t")), F.lit(False))
    marked = beside(documents)
    gone = marked.filter(old).select(F.col("scope").alias("_gs"), F.col("id").alias("_gi"))
    done = F.coalesce((F.col("kind") == "accepted") & (F.col("version") <= F.col("_r")), F.lit(False))
    return {
        "documents": marked.filter(~old).select(*documents.columns),
        "receipts": beside(receipts).filter(~done).select(*receipts.columns),
        "access": access.join(gone, (F.col("scope") == F.col("_gs")) & (F.col("id") == F.col("_gi")), "left_anti"),
        "feeds": raised.withColumn("purged_through", F.greatest("purged_through", "_through")).select(*feeds.columns),
        "samples": taken.join(per, F.col("scope") == F.col("_s"), "left").filter(F.col("_from").isNull() | (F.col("at") >= F.col("_from"))).select("scope", "at", "head"),
    }


def restored_heads(heads_: DataFrame, backup: DataFrame, scope: str = "scope") -> DataFrame:
    """Where a feed goes on after a restore under a new epoch: no version is used again."""
    both = heads_.join(backup.withColumnRenamed("head", "backup_head"), scope, "full_outer")
    return both.select(scope, F.greatest("head", "backup_head").alias("head"))


def list_page(documents: DataFrame, after: Column | None, limit: int, most: int = 1000, id_col: str = "id") -> DataFrame:
    """Live documents after an id, in id order."""
    live = documents.filter(~F.col("deleted"))
    if after is not None:
        live = live.filter(id_order(F.col(id_col)) > id_order(after))
    return live.orderBy(id_order(F.col(id_col))).limit(min(limit, most))


def snapshot(documents: DataFrame, with_deleted: bool = False) -> DataFrame:
    return documents if with_deleted else documents.filter(~F.col("deleted"))


def audit_history(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Samples whose value differs from the one before them in their series."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return samples.withColumn("_keep", first | ~F.col(value).eqNullSafe(before)).filter("_keep").drop("_keep")
