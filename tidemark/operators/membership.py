"""Row security by membership: who may read which document, and since which version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.feed import list_page, page_with_facts


def access_rows(writes: DataFrame, keys: list[str], readers: str = "readers", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """(principal, keys, version, granted): the last access change of each principal and document.

    A write grants all its readers at its version and revokes those before it who are not among them; a tombstone
    goes to whoever could read the document last, however many tombstones lie between.
    """
    history = Window.partitionBy(*keys).orderBy(version)
    empty = F.array().cast("array<string>")
    own = F.when(~F.col(deleted), F.coalesce(F.col(readers), empty))
    effective = F.coalesce(F.last(own, ignorenulls=True).over(history.rowsBetween(Window.unboundedPreceding, 0)), empty)
    known = writes.withColumn("_now", effective)
    known = known.withColumn("_before", F.coalesce(F.lag("_now").over(history), empty))
    change = lambda who, granted: F.transform(who, lambda p: F.struct(p.alias("principal"), F.lit(granted).alias("granted")))
    rows = known.select(*keys, version, F.explode(F.concat(change(F.col("_now"), True), change(F.array_except("_before", "_now"), False))).alias("a"))
    return rows.groupBy(F.col("a.principal").alias("principal"), *keys).agg(F.max(version).alias(version), F.max_by(F.col("a.granted"), F.col(version)).alias("granted"))


def access_changes(access: DataFrame, writes: DataFrame, keys: list[str], readers: str = "readers", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The access rows that a batch of writes changes or adds, from the access rows so far instead of all writes before.

    Of the documents written, those who may read now stand for what was before the batch; so the work follows the batch and
    the readers of its documents. Batches come in the order of versions. `merge_access` folds the result into the rows.
    """
    touched = writes.select(*keys).distinct()
    known = access.filter("granted").join(touched, keys, "left_semi").groupBy(*keys).agg(F.collect_set("principal").alias(readers))
    before = known.select(*keys, F.lit(-(1 << 62)).alias(version), F.lit(False).alias(deleted), readers)
    both = before.unionByName(writes.select(*keys, F.col(version).cast("long").alias(version), deleted, readers))
    return access_rows(both, keys, readers, version, deleted).filter(F.col(version) > -(1 << 62))


def merge_access(access: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The access rows after changes: those named by a change give way to it."""
    named = ["principal", *keys]
    return access.join(changes.select(*named), named, "left_anti").unionByName(changes.select(*access.columns))


def membership_page(access: DataFrame, documents: DataFrame, principal: str, since: int, limit: int, keys: list[str], removals: bool = True, can_read: Column | None = None) -> DataFrame:
    """A page of a principal's feed with `has_more` and `checkpoint`: changes where access is granted, removals where it was revoked.

    Membership filters before the limit, so pages are full; can_read, an expression over the document's columns, follows it. From the
    start, revocations are of no interest; a caller that doesn't understand removals gets `scope-changed` instead. A page
    without rows is one row of nulls with the facts.
    """
    mine = access.filter((F.col("principal") == principal) & (F.col("version") > since)).orderBy("version").limit(limit + 1)
    docs = documents.select(*(F.col(k).alias(f"_{k}") for k in keys), *[c for c in documents.columns if c not in (*keys, "version")])
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("granted")]
    joined = mine.join(docs, on, "left").drop(*(f"_{k}" for k in keys))
    kind = F.when(F.col("granted"), "change").otherwise(F.lit("removal" if removals else "scope-changed"))
    ok = F.when(F.col("granted"), F.lit(True) if can_read is None else can_read).otherwise(F.lit(since > 0))
    return page_with_facts(joined.withColumn("kind", kind), since, limit, ok)


def readable(documents: DataFrame, access: DataFrame, principal: str, keys: list[str]) -> DataFrame:
    return documents.join(access.filter((F.col("principal") == principal) & F.col("granted")), keys, "left_semi")


def get(documents: DataFrame, access: DataFrame, principal: str, ids: list[str], keys: list[str], can_read: Column | None = None, id_col: str = "id") -> DataFrame:
    """The documents of some ids, deleted ones included, that a principal has access to and that can_read lets through."""
    found = readable(documents.filter(F.col(id_col).isin(ids)), access, principal, keys)
    return found if can_read is None else found.filter(can_read)


def list_readable(documents: DataFrame, access: DataFrame, principal: str, after: Column | None, limit: int, keys: list[str], can_read: Column | None = None) -> DataFrame:
    """A page of live documents by id, of those a principal may read: here both filters precede the limit."""
    found = readable(documents, access, principal, keys)
    return list_page(found if can_read is None else found.filter(can_read), after, limit)


def orphaned(access: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Access rows whose document is gone, to be deleted with a purge."""
    return access.join(documents, keys, "left_anti")


def audiences(documents: DataFrame, access: DataFrame, keys: list[str]) -> DataFrame:
    """Current readers of each document, in order."""
    granted = access.filter("granted").groupBy(*keys).agg(F.array_sort(F.collect_set("principal")).alias("readers"))
    return documents.join(granted, keys, "left")
