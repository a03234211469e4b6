"""States, counts and rollups of replicas, sessions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("idle", "syncing", "offline", "conflicted", "failed")  # worst last


def item_state() -> Column:
    """What a user sees of a record: missing before conflicted, rejected, pending and synced."""
    return (
        F.when(F.col("missing"), "missing-after-reset").when(F.col("conflict").isNotNull(), "conflicted").when(F.col("rejection").isNotNull(), "rejected")
        .when(F.col("is_dirty"), "pending").otherwise("synced")
    )


def issue_counts(records: DataFrame) -> DataFrame:
    blocked = F.col("is_dirty") & F.col("rejection").eqNullSafe(F.lit("group-failed"))
    rejected = F.col("is_dirty") & F.col("rejection").isNotNull()
    return records.agg(
        F.count_if("is_dirty").alias("dirty"), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"), F.count_if(rejected & ~blocked).alias("rejected"), F.count_if(blocked).alias("blocked")
    )


def issues(records: DataFrame, id_order_: Column, offset: int, limit: int) -> DataFrame:
    """Conflicts, then rejected and blocked records, each by id: a page of them with the `total`; a page beyond them is one row of nulls with it."""
    conflicts = records.filter(F.col("conflict").isNotNull()).select(F.lit(0).alias("part"), "id", F.lit("conflict").alias("kind"))
    rejected = records.filter(F.col("is_dirty") & F.col("rejection").isNotNull()).select(F.lit(1).alias("part"), "id", F.when(F.col("rejection") == "group-failed", "blocked").otherwise("rejected").alias("kind"))
    both = conflicts.unionByName(rejected)
    page = both.orderBy("part", id_order_).offset(offset).limit(limit).select("id", "kind")
    return both.agg(F.count(F.lit(1)).alias("total")).join(page, F.lit(True), "left").select("id", "kind", "total")  # one row, joined with a page


def queue_gauges(records: DataFrame, keys: list[str], stamp_wall: str, now_ms: Column) -> DataFrame:
    """Depth of the queue of local changes and the age of its oldest, per replica."""
    return records.filter(F.col("is_dirty") & F.col("rejection").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"), F.greatest(F.lit(0), F.max(now_ms) - F.min(stamp_wall)).cast("long").alias("oldest_age_ms"))


def goal(wanted: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Per session, whether its goal is met: all wanted documents accepted. wanted: keys, id, revision."""
    r = records.select(F.col("id").alias("_id"), "is_dirty", "rejection", "local_revision")
    joined = wanted.join(r, F.col("id") == F.col("_id"), "left")
    open_ = F.coalesce(F.col("is_dirty") & (F.col("local_revision") >= F.col("revision")), F.lit(False))
    rejected = F.coalesce(F.col("rejection").isNotNull(), F.lit(False))
    return joined.groupBy(*keys).agg(
        F.greatest(F.lit(0), F.count_if(open_) - F.count_if(open_ & rejected)).cast("long").alias("pending"), F.count_if(open_).alias("unaccepted"), (~F.bool_or(open_)).alias("met")
    )


def coordinator(status: DataFrame, keys: list[str]) -> DataFrame:
    """One status of many collections: the worst state, sums, and the details joined in order."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("state"))
    detail = F.array_sort(F.collect_list(F.when(F.col("detail").isNotNull(), F.struct("collection", "detail"))))
    return status.groupBy(*keys).agg(
        F.get(F.array(*map(F.lit, SEVERITY)), (F.max(rank) - 1).cast("int")).alias("state"), F.sum("pending").alias("pending"), F.sum("conflicts").alias("conflicts"),
        F.array_join(F.transform(detail, lambda d: F.concat(d["collection"], F.lit(": "), d["detail"])), "; ").alias("detail"),
    )


def stale(last_pulled: Column, now: Column, threshold: Column) -> Column:
    return last_pulled.isNull() | (now - last_pulled > threshold)


def backoff(failures: Column, least_ms: int = 1000, most_ms: int = 300_000, jitter: Column | None = None, retry_after: Column | None = None) -> Column:
    """Delay after that many failures in a row: doubled up to a cap, times a jitter of 0.5 to 1, at least what the server asked for."""
    doubled = F.least(F.lit(float(most_ms)), F.lit(float(least_ms)) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30)).cast("double")))
    delay = doubled if jitter is None else doubled * (F.lit(0.5) + jitter / 2)
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after.cast("double"), F.lit(0.0)))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("kind", "duplicate", "error_code").agg(F.count(F.lit(1)).alias("n"))


def classify(key: Column, prefixes: dict[str, str], otherwise: str = "unsupported") -> Column:
    """The kind of a stored record by its key's prefix."""
    found = None
    for prefix, kind in prefixes.items():
        found = F.when(key.startswith(prefix), kind) if found is None else found.when(key.startswith(prefix), kind)
    return F.lit(otherwise) if found is None else found.otherwise(otherwise)


def diagnostic_export(records: DataFrame, prefixes: dict[str, str], now: Column) -> DataFrame:
    """Per kind and state of the payload: how many records, and the age of the oldest."""
    kinds = records.select(classify(F.col("key"), prefixes).alias("record_kind"), F.coalesce(F.get_json_object("payload", "$.state"), F.lit("none")).alias("state"), "at")
    return kinds.groupBy("record_kind", "state").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0), now - F.min("at")).cast("long").alias("oldest_age"))


def diagnostic_report(records: DataFrame, prefixes: dict[str, str], limit: int) -> DataFrame:
    """The first `limit` records by key: per kind and state how many, each row with scanned, unsupported and truncated of the whole.

    A payload that isn't a JSON object makes its record unsupported; if more records follow, the counts are partial.
    """
    window = records.orderBy("key").limit(limit + 1).withColumn("_n", F.row_number().over(Window.orderBy("key")))  # limit + 1 rows
    kind = classify(F.col("key"), prefixes)
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    seen = window.select(kind.alias("record_kind"), F.coalesce(F.get_json_object("payload", "$.state"), F.lit("none")).alias("state"), (whole & (kind != "unsupported")).alias("_ok"), (F.col("_n") <= limit).alias("_in"))
    facts = seen.agg(F.count_if("_in").alias("scanned"), F.count_if(F.col("_in") & ~F.col("_ok")).alias("unsupported"), F.coalesce(F.bool_or(~F.col("_in")), F.lit(False)).alias("truncated"))
    counts = seen.filter("_in and _ok").groupBy("record_kind", "state").agg(F.count(F.lit(1)).alias("n"))
    return facts.join(counts, F.lit(True), "left").select("record_kind", "state", "n", "scanned", "unsupported", "truncated")  # one row, joined with its kinds


def intent_status(intents: DataFrame, transport: DataFrame, execution: DataFrame) -> DataFrame:
    """Where each command document stands: persisted, sent and answered, executed."""
    t = transport.select(F.col("id").alias("_t"), F.col("kind").alias("transport"))
    e = execution.select(F.col("id").alias("_e"), F.col("state").alias("execution"))
    joined = intents.join(t, F.col("id") == F.col("_t"), "left").join(e, F.col("id") == F.col("_e"), "left")
    return joined.select("id", F.coalesce("transport", F.lit("pending")).alias("transport"), F.coalesce("execution", F.lit("unknown")).alias("execution"))


def run_histogram(runs: DataFrame, keys: list[str], value: str, bounds: list[int]) -> DataFrame:
    """Counts of run durations per bucket (the least bound that is not exceeded; null beyond the last)."""
    bucket = None
    for b in bounds:
        bucket = F.when(F.col(value) <= b, F.lit(b)) if bucket is None else bucket.when(F.col(value) <= b, F.lit(b))
    return runs.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
