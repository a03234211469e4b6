"""A replica's records: applying pages, acknowledgements, conflicts and resets as set-based transitions.

Record columns: id, current, base, base_version, is_dirty, local_revision, pending_op, pending_revision, pending_group,
rejection, observed, observed_version, generation, missing, conflict (kept local change) and conflict_version,
group_id. Rejected records are dirty. Documents are opaque columns here (text or struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators.numbering import lot_of, number_rows

RECORD = "id STRING, current STRING, base STRING, base_version BIGINT, is_dirty BOOLEAN, local_revision BIGINT, pending_op STRING, pending_revision BIGINT, pending_group STRING, rejection STRING, observed STRING, observed_version BIGINT, generation BIGINT, missing BOOLEAN, conflict STRING, conflict_version BIGINT, group_id STRING"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = {c.split()[0]: c.split()[1] for c in RECORD.split(", ")}


def null(column: str) -> Column:
    return F.lit(None).cast(_TYPES[column])


def known_version() -> Column:
    return F.greatest("base_version", "observed_version")


def members() -> WindowSpec:
    """A group's records; one without a group is alone, so that these don't all meet in one task."""
    return Window.partitionBy("group_id", F.when(F.col("group_id").isNull(), F.col("id")))


def pushable() -> Column:
    return F.col("is_dirty") & F.col("rejection").isNull()


def changed(records: DataFrame, when: Column, **new: Column) -> DataFrame:
    """records with some columns replaced in the rows that meet a condition; all conditions see the old values."""
    hit = F.coalesce(when, F.lit(False))
    return records.select(*(F.when(hit, new[c].cast(records.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in records.columns))


def apply_remote(records: DataFrame, changes: DataFrame, generation: int, pull_only: bool = False, show_local: bool = False) -> DataFrame:
    """Apply pulled changes (id, document, version), at most one per id, to the records.

    New ids become clean records; what is known already in this generation is ignored; dirty records only remember
    the newer server state and are visible again; clean ones are replaced, except that a kept conflict which shows
    the local edit keeps showing it and moves its server side.
    """
    c = changes.select(F.col("id").alias("c_id"), F.col("document").alias("c_doc"), F.col("version").alias("c_version"))
    both = records.withColumn("_old", F.lit(True)).join(c, F.col("id") == F.col("c_id"), "full_outer")
    fresh = F.col("_old").isNull()
    ignored = ~fresh & (F.col("c_id").isNull() | (F.col("generation").eqNullSafe(F.lit(generation)) & F.coalesce(known_version() >= F.col("c_version"), F.lit(False))))
    dirty = ~fresh & ~ignored & F.col("is_dirty")
    clean = ~fresh & ~ignored & ~F.col("is_dirty")
    kept = clean & F.col("conflict").isNotNull() & F.lit(show_local)
    document, base = F.col("c_doc"), F.lit(None) if pull_only else F.col("c_doc")
    pick = lambda name, **cases: _pick(name, {"fresh": fresh, "dirty": dirty, "clean": clean}, cases)
    out = {
        "id": F.coalesce("id", "c_id"),
        "current": F.when(kept, F.col("current")).when(fresh | clean, document).otherwise(F.col("current")),
        "base": F.when(fresh | clean, base.cast("string") if pull_only else base).otherwise(F.col("base")),
        "base_version": F.when(fresh | clean, F.col("c_version")).otherwise(F.col("base_version")),
        "is_dirty": pick("is_dirty", fresh=F.lit(False)),
        "local_revision": pick("local_revision", fresh=F.lit(0)),
        "observed": pick("observed", dirty=document, clean=null("observed")),
        "observed_version": pick("observed_version", dirty=F.col("c_version"), clean=null("observed_version")),
        "generation": F.when(fresh | dirty | clean, F.lit(generation)).otherwise(F.col("generation")).cast("long"),
        "missing": F.when(fresh | dirty | clean, F.lit(False)).otherwise(F.col("missing")),
        "conflict_version": F.when(kept, F.col("c_version")).otherwise(F.col("conflict_version")),
    }
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns))


def _pick(name: str, where: dict[str, Column], cases: dict[str, Column]) -> Column:
    picked = F.col(name)
    for case, value in cases.items():
        picked = F.when(where[case], value).otherwise(picked)
    return picked


def settle(records: DataFrame) -> DataFrame:
    """Forget an observed state that the base has caught up with; a clean record adopts one that is newer."""
    stale = F.coalesce(F.col("observed_version") <= F.col("base_version"), F.lit(False))
    adopt = F.col("observed_version").isNotNull() & ~stale & ~F.col("is_dirty")
    moved = changed(records, adopt, current=F.col("observed"), base=F.col("observed"), base_version=F.col("observed_version"), observed=null("observed"), observed_version=null("observed_version"))
    return changed(moved, F.coalesce(F.col("observed_version") <= F.col("base_version"), F.lit(False)), observed=null("observed"), observed_version=null("observed_version"))


def acknowledge(records: DataFrame, outcomes: DataFrame, generation: int) -> DataFrame:
    """Apply accepted and rejected outcomes (operation_id, kind, version, document, error_code) of pending operations.

    Only the revision that was sent becomes clean or rejected; a later edit stays dirty on the new base. `base-expired`
    forgets the base, so that the next edit is a new document.
    """
    o = outcomes.filter(F.col("kind").isin("accepted", "rejected")).select(F.col("operation_id").alias("o_id"), F.col("kind").alias("o_kind"), F.col("version").alias("o_version"), F.col("document").alias("o_doc"), F.col("error_code").alias("o_code"))
    both = records.join(o, F.col("pending_op") == F.col("o_id"), "left")
    accepted, rejected = F.coalesce(F.col("o_kind") == "accepted", F.lit(False)), F.coalesce(F.col("o_kind") == "rejected", F.lit(False))
    same = F.col("local_revision").eqNullSafe(F.col("pending_revision"))
    expired = rejected & F.col("o_code").eqNullSafe(F.lit("base-expired"))
    hit = accepted | rejected
    case = lambda name, *pairs: _ladder(F.col(name), pairs)
    out = {
        "current": case("current", (accepted & same, F.col("o_doc"))),
        "base": case("base", (accepted, F.col("o_doc")), (expired, null("base"))),
        "base_version": case("base_version", (accepted, F.col("o_version")), (expired, null("base_version"))),
        "is_dirty": case("is_dirty", (accepted & same, F.lit(False))),
        "rejection": case("rejection", (accepted & same, null("rejection")), (rejected & same, F.coalesce("o_code", F.lit("rejected")))),
        "observed": case("observed", (expired, null("observed"))),
        "observed_version": case("observed_version", (expired, null("observed_version"))),
        "generation": case("generation", (accepted, F.lit(generation).cast("long"))),
        "group_id": case("group_id", (accepted & F.col("pending_group").isNotNull() & (F.col("group_id") == F.col("pending_group")), null("group_id"))),
        "pending_op": case("pending_op", (hit, null("pending_op"))),
        "pending_revision": case("pending_revision", (hit, null("pending_revision"))),
        "pending_group": case("pending_group", (hit, null("pending_group"))),
        "_acked": accepted,
    }
    moved = both.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns), out["_acked"].alias("_acked"))
    settled = settle(moved.filter("_acked").drop("_acked"))
    return settled.unionByName(moved.filter("not _acked").drop("_acked"))


def _ladder(otherwise: Column, pairs) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def resolve(records: DataFrame, decisions: DataFrame, generation: int, show_local: bool = False) -> DataFrame:
    """Commit a handler's decisions (operation_id, outcome, server, server_version, resolved) on conflicts.

    outcome: use-master, keep-fork, use-resolved or defer (keep the local change as a conflict for the user).
    """
    d = decisions.select(F.col("operation_id").alias("d_id"), "outcome", F.col("server").alias("d_server"), F.col("server_version").alias("d_version"), F.col("resolved").alias("d_resolved"), F.col("revision").alias("d_revision"))
    both = records.join(d, F.col("pending_op") == F.col("d_id"), "left")
    hit = F.col("d_id").isNotNull()
    edited = hit & ~F.col("local_revision").eqNullSafe(F.col("d_revision"))
    go = hit & ~edited
    is_ = lambda name: go & (F.col("outcome") == name)
    master, fork, ours, defer = is_("use-master"), is_("keep-fork"), is_("use-resolved"), is_("defer")
    case = lambda name, *pairs: _ladder(F.col(name), pairs)
    out = {
        "current": case("current", (master | (defer & F.lit(not show_local)), F.col("d_server")), (ours, F.col("d_resolved"))),
        "base": case("base", (go, F.col("d_server"))),
        "base_version": case("base_version", (go, F.col("d_version"))),
        "is_dirty": case("is_dirty", (master | defer, F.lit(False)), (fork | ours, F.lit(True))),
        "local_revision": case("local_revision", (ours, F.col("local_revision") + 1)),
        "rejection": case("rejection", (master | defer, null("rejection"))),
        "conflict": case("conflict", (defer, F.col("current"))),
        "conflict_version": case("conflict_version", (defer, F.col("d_version"))),
        "generation": case("generation", (go, F.lit(generation).cast("long"))),
        "pending_op": case("pending_op", (hit, null("pending_op"))),
        "pending_revision": case("pending_revision", (hit, null("pending_revision"))),
        "pending_group": case("pending_group", (hit, null("pending_group"))),
    }
    return settle(both.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns)))


def remove(records: DataFrame, removed: DataFrame, generation: int) -> DataFrame:
    """Ids that left the caller's view: clean copies go, records with local work are hidden."""
    both = records.join(removed.select(F.col("id").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left")
    work = F.col("is_dirty") | F.col("conflict").isNotNull()
    kept = both.filter(F.col("_r").isNull() | work)
    hide = F.col("_r").isNotNull() & ~F.col("missing")
    return changed(kept, hide, missing=F.lit(True), generation=F.lit(generation)).drop("_r")


def sweep(records: DataFrame, generation: int, purge: bool) -> DataFrame:
    """End of a resnapshot: clean records that it didn't bring are purged or hidden; kept conflicts are only hidden."""
    stale = ~F.col("is_dirty") & ~F.col("missing") & (F.col("generation") < generation)
    kept = records.filter(~(stale & F.col("conflict").isNull())) if purge else records
    return changed(kept, stale, missing=F.lit(True), generation=F.lit(generation))


def compact(records: DataFrame, deleted: Column, horizon: Column | int, generation: int) -> DataFrame:
    """Drop tombstones that every server state at the horizon knows: clean, without conflict, of this generation."""
    gone = deleted & ~F.col("is_dirty") & F.col("conflict").isNull() & (F.col("base_version") <= horizon) & (F.col("generation") == generation)
    return records.filter(~F.coalesce(gone, F.lit(False)))


def reset(cursors: DataFrame, reason: str) -> DataFrame:
    """The cursors after a reset: start again, one generation on; an unseen rest is purged unless only the epoch changed."""
    return cursors.select("replica", F.lit(None).cast("string").alias("checkpoint"), (F.col("generation") + 1).alias("generation"), F.lit(True).alias("resnapshot"), (F.col(reason) != "epoch").alias("purge_missing"))


def write(records: DataFrame, writes: DataFrame) -> DataFrame:
    """Local saves and deletes (id, document, delete, group_id): one more revision, dirty, visible, no rejection.

    Deleting what isn't there does nothing. A group id is that of the writes made together, or null.
    """
    w = writes.select(F.col("id").alias("w_id"), F.col("document").alias("w_doc"), F.col("delete").alias("w_delete"), F.col("group_id").alias("w_group"))
    both = records.withColumn("_old", F.lit(True)).join(w, F.col("id") == F.col("w_id"), "full_outer").filter("_old is not null or not w_delete")
    hit = F.col("w_id").isNotNull()
    out = {
        "id": F.coalesce("id", "w_id"),
        "current": F.when(hit & ~F.col("w_delete"), F.col("w_doc")).otherwise(F.col("current")),
        "is_dirty": F.when(hit, F.lit(True)).otherwise(F.col("is_dirty")),
        "local_revision": F.coalesce("local_revision", F.lit(0).cast("long")) + hit.cast("long"),
        "rejection": F.when(~hit, F.col("rejection")),
        "missing": F.when(hit, F.lit(False)).otherwise(F.col("missing")),
        "group_id": F.when(hit, F.col("w_group")).otherwise(F.col("group_id")),
        "generation": F.coalesce("generation", F.lit(0).cast("long")),
    }
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns))


def discard_conflicts(records: DataFrame, ids: Column) -> DataFrame:
    """The chosen kept conflicts are dropped and show the latest server state."""
    return changed(records, ids & F.col("conflict").isNotNull(), conflict=null("conflict"), conflict_version=null("conflict_version"), current=F.coalesce("base", "current"))


def retry(records: DataFrame, ids: Column) -> DataFrame:
    """The chosen rejected changes are sent again as new operations."""
    none = {c: null(c) for c in ("pending_op", "pending_revision", "pending_group", "rejection")}
    return changed(records, ids & F.col("rejection").isNotNull(), is_dirty=F.lit(True), local_revision=F.col("local_revision") + 1, **none)


def revert(records: DataFrame, ids: Column) -> DataFrame:
    """The chosen local changes are dropped for the newest server state known; without one the record is hidden."""
    hit = ids & F.col("is_dirty")
    newer = F.col("observed_version").isNotNull() & F.col("observed").isNotNull() & F.coalesce(F.col("observed_version") > F.col("base_version"), F.col("base_version").isNull())
    base = F.when(newer, F.col("observed")).otherwise(F.col("base"))
    return changed(
        records, hit, is_dirty=F.lit(False), local_revision=F.col("local_revision") + 1, current=F.coalesce(base, F.col("current")), base=base,
        base_version=F.when(newer, F.col("observed_version")).otherwise(F.col("base_version")), missing=F.when(base.isNotNull(), F.lit(False)).otherwise(F.lit(True)),
        **{c: null(c) for c in ("pending_op", "pending_revision", "pending_group", "rejection", "observed", "observed_version")},
    )


def export_changes(records: DataFrame) -> DataFrame:
    """Every record with local work: pending, rejected or a kept conflict."""
    return records.filter(pushable() | (F.col("is_dirty") & F.col("rejection").isNotNull()) | F.col("conflict").isNotNull())


def import_changes(records: DataFrame, exported: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """(records with the exported work, ids skipped): only where the replica has no work of its own."""
    busy = records.filter(F.col("is_dirty") | F.col("conflict").isNotNull()).select("id")
    skipped = exported.select("id").join(busy, "id", "left_semi")
    taken = exported.join(busy, "id", "left_anti")
    taken = changed(taken, F.lit(True), generation=F.least(F.col("generation"), F.lit(generation)), missing=F.lit(False))
    return records.join(taken.select("id"), "id", "left_anti").unionByName(taken), skipped


def prepare(records: DataFrame, candidates: Column, pending_size: Column | None = None) -> DataFrame:
    """Operations to send: of each candidate the pending one if its group and that group's size still fit, else a new one.

    A group is as large as its candidates are many, and is sent only if all of them may be. pending_size: the size of the group when
    the pending operation was made. Returns id, group_id, group_size, renew.
    """
    chosen = records.filter(candidates)
    size = F.when(F.col("group_id").isNotNull(), F.count(F.lit(1)).over(members())).otherwise(F.lit(0)).cast("long")
    chosen = chosen.withColumns({"group_size": size, "_whole": F.bool_and(pushable()).over(members())}).filter(pushable() & (F.col("group_id").isNull() | F.col("_whole")))
    renew = F.col("pending_op").isNull() | ~F.col("pending_group").eqNullSafe(F.col("group_id"))
    if pending_size is not None:
        renew = renew | ~F.coalesce(pending_size, F.lit(0)).eqNullSafe(F.col("group_size"))
    return chosen.select("id", "group_id", "group_size", renew.alias("renew"))


def held_back(records: DataFrame, ready: Column) -> DataFrame:
    """Pushable records with whether they are held back: a group waits for each of its members."""
    own = records.filter(pushable()).withColumn("_hold", ~ready)
    group = F.bool_or("_hold").over(members())
    return own.withColumn("held", F.when(F.col("group_id").isNotNull(), group).otherwise(F.col("_hold"))).drop("_hold")


def park(records: DataFrame, failed: DataFrame, code: str = "group-failed") -> DataFrame:
    """Dirty members of failed groups are rejected with a code of their own until the group is released."""
    both = records.join(failed.select(F.col("group_id").alias("_g")).distinct(), F.col("group_id") == F.col("_g"), "left")
    return changed(both, F.col("_g").isNotNull() & F.col("is_dirty") & F.col("rejection").isNull(), rejection=F.lit(code)).drop("_g")


def restamp(records: DataFrame, node: str, now_ms: int, updated_at: str = "updated_at", most_ahead_ms: int = 300_000) -> DataFrame:
    """(id, place, stamp): new stamps for what was rejected for clock skew, and for the failed rest of those groups, in the order of the old ones.

    The clock goes back to the latest stamp of the other records that isn't too far ahead, and then gives stamps in turn.
    """
    skewed = F.col("rejection") == "clock-skew"
    with_group = F.bool_or(skewed).over(members())
    hit = records.withColumn("_s", F.coalesce(F.when(F.col("group_id").isNotNull(), with_group).otherwise(skewed) & F.col("rejection").isin("clock-skew", "group-failed"), F.lit(False)))
    wall = clock.parse(F.col(updated_at))["wall"]
    last = hit.filter(~F.col("_s") & (wall <= now_ms + most_ahead_ms)).agg(F.max(updated_at).alias("_floor"))  # one row
    over = clock.MOST_COUNTER + 1
    floor = clock.parse(F.col("_floor"))
    ticks = F.greatest(F.coalesce(floor["wall"] * over + floor["counter"], F.lit(0)) + 1, F.lit(now_ms * over))
    targets = hit.filter("_s").select("id", F.col(updated_at).alias("_old"), F.lit(0).alias("_all"))
    lots = F.coalesce(lot_of(clock.parse(F.col("_old"))["wall"]), F.lit(-1))
    numbered = number_rows(targets, ["_all"], ["_old", "id"], lots).crossJoin(F.broadcast(last)).withColumn("place", F.col("number") - 1)
    stamp = clock.encode(F.floor((ticks + F.col("place")) / over), (ticks + F.col("place")) % over, F.lit(node))
    return numbered.select("id", "place", stamp.alias("stamp"))


def batches(units: DataFrame, most_bytes: int, request: list[str], order: str = "pos") -> DataFrame:
    """Batches by halving: one above the limit splits into halves of its units until it fits or is a single one.

    units: one row a group or lone operation with its bytes. A request is bounded in units, so its running sums fit a
    row; halving depends only on a unit's place, so it is an expression over them.
    """
    placed = units.withColumn("_i", F.row_number().over(Window.partitionBy(*request).orderBy(order)) - 1)
    placed = placed.withColumn("_s", F.sum("bytes").over(Window.partitionBy(*request).orderBy(order)))
    whole = Window.partitionBy(*request)
    sums = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s")).over(whole)), lambda x: x["_s"])
    ranged = placed.withColumn("_sums", sums).withColumn("_n", F.count(F.lit(1)).over(whole).cast("int"))
    upto = lambda i: F.when(i > 0, F.get(F.col("_sums"), i - 1)).otherwise(F.lit(0))

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = low + F.floor((high - low) / 2).cast("int")
        split = (high - low > 1) & (upto(high) - upto(low) > most_bytes)
        left = F.col("_i") < middle
        return F.struct(F.when(split & ~left, middle).otherwise(low).alias("low"), F.when(split & left, middle).otherwise(high).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.col("_n").alias("high"))
    span = ranged.withColumn("_span", F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, halve))
    too_large = (F.col("_span.high") - F.col("_span.low") == 1) & (F.col("bytes") > most_bytes)
    return span.select(*units.columns, F.col("_span.low").cast("long").alias("batch_from"), F.col("_span.high").cast("long").alias("batch_to"), too_large.alias("too_large"))


def release(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of which a member was retried or resolved: their parked members may be sent again."""
    both = records.join(groups.select(F.col("group_id").alias("_g")).distinct(), F.col("group_id") == F.col("_g"), "left")
    hit = F.col("_g").isNotNull() & F.col("rejection").isin("group-failed", "groups-unsupported")
    return changed(both, hit, rejection=null("rejection"), pending_op=null("pending_op"), pending_revision=null("pending_revision"), pending_group=null("pending_group")).drop("_g")


def resolve_kept(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Kept conflicts that the user settled with a document (id, document): a local change on the latest server state."""
    r = resolved.select(F.col("id").alias("_r"), F.col("document").alias("_d"))
    both = records.join(r, F.col("id") == F.col("_r"), "left")
    hit = F.col("_r").isNotNull() & F.col("conflict").isNotNull()
    new = {"current": F.col("_d"), "is_dirty": F.lit(True), "local_revision": F.col("local_revision") + 1, "missing": F.lit(False)}
    return changed(both, hit, **new, **{c: null(c) for c in ("rejection", "conflict", "conflict_version")}).drop("_r", "_d")


def updated(records: DataFrame, updates: DataFrame, keep: Column) -> DataFrame:
    """The records after a set of updates, with `changed`: an update's row replaces or adds its record, unless keep leaves it as it is.

    updates: the records' columns and those keep uses; an id that comes twice is refused before anything changes, as is a null one.
    """
    faulty = updates.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1).collect()
    if faulty:
        raise ValueError(f"an update has each record id once, not {faulty[0]['id']!r}")
    new = updates.filter(~F.coalesce(keep, F.lit(False))).select(F.struct(*records.columns).alias("_new"))
    both = records.select(F.struct(*records.columns).alias("_old")).join(new, F.col("_old.id") == F.col("_new.id"), "full_outer")
    return both.select(F.coalesce("_new", "_old").alias("_r"), F.col("_new").isNotNull().alias("changed")).select("_r.*", "changed")
