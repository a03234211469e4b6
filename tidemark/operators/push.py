"""Batches of optimistic writes: decided as a set, exactly once, groups all or nothing.

Operations (ops): scope, pos (place in the request), operation_id, document_id, base_version, body_id (the id inside the
document), updated_at, payload, group, group_size. Documents: scope, id, version, payload. Receipts: operation_id,
fingerprint, kind, version, error_code. Feeds: scope, head, purged_through.

An operation without a scope or a position is malformed as any other, and answered `invalid`.

A request holds one deciding operation per document, so no decision depends on another's effect: joins find what
exists, one ladder of conditions decides, windows over a group or a document settle what members share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions.ids import id_valid, utf16_units
from tidemark.operators.numbering import lot_of, number_rows
from tidemark.sources.scratch import stored

MOST_SKEW_MS = 300_000


def fingerprint() -> Column:
    """Digest of what an operation asks for; a resend has the same."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(utf16_units(F.col("document_id")).cast("string"), F.lit(":"), F.col("document_id"))
    return F.upper(F.sha2(F.concat_ws("|", head, text("base_version"), text("group"), text("group_size"), text("payload")), 256))


def members() -> WindowSpec:
    """A group's operations; one without a group is alone, so that these don't all meet in one task."""
    return Window.partitionBy("scope", "group", "solo")


def solo() -> Column:
    return F.when(F.col("group").isNull(), F.coalesce(F.col("pos"), F.xxhash64("operation_id", "document_id", "payload")))


def malformed() -> Column:
    return (
        ~id_valid(F.col("operation_id")) | ~id_valid(F.col("document_id")) | F.col("payload").isNull() | ~F.col("body_id").eqNullSafe(F.col("document_id"))
        | F.coalesce(F.col("base_version") < 1, F.lit(False)) | F.col("scope").isNull() | F.col("pos").isNull()
    )


def evaluate(ops: DataFrame, documents: DataFrame, receipts: DataFrame, feeds: DataFrame, now_ms: int, can_write: Column | None = None, may_read: Column | None = None, validator: Column | None = None, handler: Column | None = None, canonical: Column | None = None, arguments: Column | None = None) -> DataFrame:
    """ops with kind, error_code, current version where one decides, and duplicate; accepted where nothing speaks against it.

    can_write, may_read, validator (an error code or null) and handler (null to accept, or struct(kind, error_code)) are
    expressions over the operation's columns and `current_version`, `current_payload`. So are canonical, the payload a handler
    stores in place of an accepted one (null keeps it), and arguments, a map of texts that goes with a fresh refusal.
    """
    grouped = F.col("group").isNotNull()
    first = F.when(grouped, F.min("pos").over(members())).otherwise(F.col("pos"))
    order = [grouped, "first_pos", "pos"]
    alone = ops.select("*", solo().alias("solo"), fingerprint().alias("fingerprint"), malformed().alias("malformed"))
    bad = alone.select("*", first.alias("first_pos"), F.count(F.lit(1)).over(members()).alias("_members"))
    # Documents are claimed in processing order by operations that are well formed; these come first in the window. The
    # window and the join with the documents share one exchange, as do the receipts' join and the window by operation id.
    # Ids of malformed operations, which may all be empty, get a key of their own.
    own = lambda c, wrong: F.when(F.col(wrong), F.concat(F.lit("\u0000"), F.coalesce("pos", F.xxhash64("operation_id", "document_id", "payload")).cast("string"))).otherwise(F.col(c))
    bad = bad.withColumn("_claim", own("document_id", "malformed"))
    claims = Window.partitionBy("scope", "_claim").orderBy("malformed", *order)
    d = documents.select(F.col("scope").alias("d_scope"), F.col("id").alias("d_id"), F.col("version").alias("current_version"), F.col("payload").alias("current_payload"))
    claimed = bad.withColumn("malformed", F.col("malformed") | (F.row_number().over(claims) > 1))
    found = claimed.join(d, (F.col("scope") == F.col("d_scope")) & (F.col("_claim") == F.col("d_id")), "left")
    size_is_wrong = ~id_valid(F.col("group")) | ~F.col("group_size").eqNullSafe(F.col("_members"))
    spoiled = F.bool_or(F.col("malformed") | size_is_wrong).over(members())
    marked = found.withColumn("invalid", F.col("malformed") | (grouped & F.coalesce(spoiled, F.lit(False))))
    r = receipts.select(F.col("operation_id").alias("r_id"), F.col("fingerprint").alias("r_print"), F.col("kind").alias("r_kind"), F.col("version").alias("r_version"), F.col("error_code").alias("r_code"))
    replayed = marked.withColumn("_use", own("operation_id", "malformed")).join(r, F.col("_use") == F.col("r_id"), "left")
    # An operation id that an earlier unit of the request used stands for another document: its receipt differs.
    unit = F.struct(grouped.alias("g"), F.col("first_pos").alias("p"))
    uses = Window.partitionBy("_use", "scope").orderBy("invalid", *order)
    used = replayed.withColumn("used_before", F.first(unit).over(uses) != unit)
    f = feeds.select(F.col("scope").alias("f_scope"), "head", "purged_through")
    joined = used.join(f, F.col("scope") == F.col("f_scope"), "left")
    exists = F.col("d_id").isNotNull()
    same = F.col("r_print") == F.col("fingerprint")
    outcome = lambda kind, code=None: F.struct(F.lit(kind).alias("kind"), (F.lit(code) if code is None or isinstance(code, str) else code).cast("string").alias("error_code"))
    ladder = (
        F.when(F.col("invalid"), outcome("rejected", "invalid"))
        .when(same, F.struct(F.col("r_kind").alias("kind"), F.col("r_code").alias("error_code")))
        .when(F.col("r_id").isNotNull() | F.col("used_before"), outcome("rejected", "operation-id-reused"))
        .when(clock.parse(F.col("updated_at"))["wall"] > now_ms + MOST_SKEW_MS, outcome("rejected", "clock-skew"))
        .when(~exists & (F.col("base_version") <= F.coalesce("purged_through", F.lit(0))), outcome("rejected", "base-expired"))
        .when((~can_write if can_write is not None else F.lit(False)) | (exists & (~may_read if may_read is not None else F.lit(False))), outcome("rejected", "forbidden"))
    )
    if validator is not None:
        ladder = ladder.when(validator.isNotNull(), outcome("rejected", validator))
    ladder = ladder.when(exists & ~F.col("base_version").eqNullSafe(F.col("current_version")), outcome("conflict"))
    if handler is not None:
        ladder = ladder.when(handler.isNotNull(), handler)
    decided = joined.withColumn("_o", ladder.otherwise(outcome("accepted")))
    duplicate = ~F.col("invalid") & F.coalesce(same, F.lit(False))
    version = F.when(duplicate, F.col("r_version")).when(F.col("_o.kind") == "conflict", F.col("current_version"))
    fresh = lambda kind: ~duplicate & (F.col("_o.kind") == kind)
    own = {c: F.col(c) for c in ops.columns}
    if canonical is not None:
        own["payload"] = F.when(fresh("accepted"), F.coalesce(canonical, "payload")).otherwise(F.col("payload")).alias("payload")
    if arguments is not None:
        own["arguments"] = F.when(fresh("rejected"), F.map_entries(arguments)).alias("arguments")  # a map can't be hashed
    return decided.select(*own.values(), "fingerprint", "first_pos", F.col("_o.kind").alias("kind"), F.col("_o.error_code").alias("error_code"), version.alias("version"), duplicate.alias("duplicate"), "invalid", F.coalesce("head", F.lit(0)).alias("head"))


def settle_groups(evaluated: DataFrame) -> DataFrame:
    """Members that would be accepted wait, undecided, unless all members of their group are.

    evaluated: scope, pos, group, kind, error_code, duplicate; other columns pass. What has no group is neither counted nor
    changed, so its part of the key only spreads it, and needs no columns but these.
    """
    every = F.bool_and(F.col("kind") == "accepted").over(members())
    waits = F.col("group").isNotNull() & (F.col("kind") == "accepted") & ~F.col("duplicate") & ~every
    alone = F.when(F.col("group").isNull(), F.coalesce(F.col("pos"), F.xxhash64("kind", "error_code")))
    marked = evaluated.withColumn("solo", alone).withColumn("_w", waits)
    new = {"kind": F.when(F.col("_w"), "retry-later").otherwise(F.col("kind")), "error_code": F.when(F.col("_w"), "group-aborted").otherwise(F.col("error_code"))}
    return marked.withColumns(new).drop("_w", "solo")


def assign_versions(settled: DataFrame) -> DataFrame:
    """Fresh accepted operations get the feed's next versions: independent ones in request order, then groups by first member.

    The decisions are stored before, since numbering reads them twice; the others pass by it.
    """
    settled = stored(settled, "decided")
    fresh = (F.col("kind") == "accepted") & ~F.col("duplicate")
    grouped = F.col("group").isNotNull()
    lot = grouped.cast("long") * F.lit(1 << 40) + lot_of(F.col("first_pos"))
    counted = number_rows(settled.filter(fresh), ["scope"], [grouped, "first_pos", "pos"], lot, "_n")
    return counted.withColumn("version", F.col("head") + F.col("_n")).drop("_n").unionByName(settled.filter(~F.coalesce(fresh, F.lit(False))))


def push(ops: DataFrame, documents: DataFrame, receipts: DataFrame, feeds: DataFrame, now_ms: int, **rules) -> DataFrame:
    """Outcome of each operation: scope, pos, operation_id, document_id, kind, version, error_code, duplicate (and fingerprint)."""
    done = assign_versions(settle_groups(evaluate(ops, documents, receipts, feeds, now_ms, **rules)))
    extra = [F.map_from_entries("arguments").alias("arguments")] if "arguments" in done.columns else []
    return done.select("scope", "pos", "operation_id", "document_id", "kind", "version", "error_code", "duplicate", "fingerprint", "payload", "invalid", *extra)


def new_receipts(outcomes: DataFrame) -> DataFrame:
    """Receipts to remember: of decisions, not of malformed, reused or undecided operations."""
    decided = ~F.col("invalid") & ~F.col("duplicate") & (F.col("kind") != "retry-later") & ~F.col("error_code").eqNullSafe(F.lit("operation-id-reused"))
    return outcomes.filter(decided).select("operation_id", "fingerprint", "kind", "version", "error_code")


def committed(outcomes: DataFrame) -> DataFrame:
    """Documents of which observers are told."""
    return outcomes.filter((F.col("kind") == "accepted") & ~F.col("duplicate")).select("scope", "document_id").distinct()


def masked(outcomes: DataFrame, readable: Column) -> DataFrame:
    """Outcomes that would show a document its caller may not read are answered `forbidden`."""
    hide = F.col("kind").isin("accepted", "conflict") & ~readable
    return outcomes.withColumn("error_code", F.when(hide, "forbidden").otherwise(F.col("error_code"))).withColumn("version", F.when(~hide, F.col("version"))).withColumn("kind", F.when(hide, "rejected").otherwise(F.col("kind")))


def correlate(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What a client makes of a response: each operation once, missing ones deferred, unknown or repeated outcomes faults."""
    once = outcomes.groupBy("operation_id").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    both = ops.select("operation_id", F.lit(True).alias("known")).join(once, "operation_id", "full_outer")
    state = F.when(F.col("known").isNull(), "unknown-outcome").when(F.col("n") > 1, "repeated-outcome").when(F.col("n").isNull(), "deferred").otherwise(F.col("kind"))
    return both.select("operation_id", state.alias("state"))
