"""Content-addressed blobs: dedupe, verification, eviction, inventories, chunks and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import lot_of, running

#: Transfer states that may run, and those that end.
RUNNABLE = ("queued", "waiting", "interrupted")


def dedupe(blobs: DataFrame, content: str) -> DataFrame:
    """One row per content: digest, size, and how often it is stored."""
    return blobs.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.max(F.octet_length(content)).cast("long").alias("size"), F.count(F.lit(1)).alias("copies"))


def verify(expected: DataFrame, stored: DataFrame, content: str, most_bytes: int | None = None) -> DataFrame:
    """missing, invalid, verified or limit for each expected (id, sha256, size)."""
    s = stored.select(F.col("id").alias("_id"), F.octet_length(content).alias("_size"), F.sha2(F.col(content), 256).alias("_sha"), F.lit(True).alias("_there"))
    joined = expected.join(s, F.col("id") == F.col("_id"), "left")
    over = F.lit(False) if most_bytes is None else F.col("size") > most_bytes
    result = F.when(over, "limit").when(F.col("_there").isNull(), "missing").when((F.col("_size") != F.col("size")) | (F.col("_sha") != F.col("sha256")), "invalid").otherwise("verified")
    return joined.select("id", result.alias("result"))


def size_conflicts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Digests for which different sizes are stated."""
    return items.groupBy(*keys, "sha256").agg(F.countDistinct("size").alias("sizes")).filter("sizes > 1")


def age_lot() -> Column:
    """Lots in the order of (accessed, sha256), without an access time first and by the digest's first digits."""
    digits = F.conv(F.substring("sha256", 1, 3), 16, 10).cast("long")
    return F.coalesce(lot_of(F.col("accessed")), F.coalesce(digits, F.lit(-1)) - (1 << 60))


def evict(files: DataFrame, budget: int, keep: Column) -> DataFrame:
    """The files to delete, least recently used first, until the total is within the budget; kept ones count but stay.

    files: sha256, length, accessed (a number; a file that was never used goes first). The running sum is spread over
    lots of the access time, or of the digest where there is none.
    """
    total = files.agg(F.sum("length").alias("_total"))
    loose = files.filter(~keep).withColumn("_all", F.lit(0))
    summed = running(loose, ["_all"], ["accessed", "sha256"], age_lot(), sums={"_upto": F.col("length").cast("long")})
    gone = summed.crossJoin(F.broadcast(total)).filter(F.col("_total") - (F.col("_upto") - F.col("length")) > budget)  # total is one row
    return gone.select("sha256", "length", "accessed")


def reserve(entries: DataFrame, additional: int, soft: int, hard: int, page: int = 32) -> DataFrame:
    """The entries evicted to make room, or none with `refused` if even all of them don't make it.

    entries: sha256, reserved, stored, accessed, pins (array). A pass takes up to `page` unpinned entries by age and
    evicts down to the soft budget; more passes follow only while the hard budget is exceeded.
    """
    sized = entries.withColumn("bytes", F.greatest("reserved", "stored")).withColumn("_all", F.lit(0))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    loose = sized.filter((F.size("pins") == 0) & (F.col("bytes") > 0))
    numbered = running(loose, ["_all"], ["accessed", "sha256"], age_lot(), sums={"_upto": F.col("bytes").cast("long"), "_n": F.lit(1)})
    placed = numbered.crossJoin(F.broadcast(total)).withColumn("_left", F.col("_total") - (F.col("_upto") - F.col("bytes")))
    # A pass is needed while its start is above the hard budget (the first is always made); in it, go down to the soft one.
    per_pass = placed.withColumn("_pass", F.floor((F.col("_n") - 1) / page))
    begins = per_pass.groupBy("_pass").agg(F.max("_left").alias("_begin"))
    runs = per_pass.join(begins, "_pass")
    made = (F.col("_pass") == 0) | (F.col("_begin") > hard - additional)
    return runs.filter(made & (F.col("_left") > soft - additional)).select("sha256", "bytes")


def pinned(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Owners of each entry after pins and unpins (sha256, owner, pin), of which the last per owner counts (by seq)."""
    last = changes.groupBy("sha256", "owner").agg(F.max_by("pin", "seq").alias("pin"))
    add = F.array_sort(F.collect_list(F.when(F.col("pin"), F.col("owner"))))
    drop = F.array_sort(F.collect_list(F.when(~F.col("pin"), F.col("owner"))))
    delta = last.groupBy("sha256").agg(add.alias("_add"), drop.alias("_drop"))
    empty = F.array().cast("array<string>")
    owners = F.array_sort(F.array_except(F.array_union("pins", F.coalesce("_add", empty)), F.coalesce("_drop", empty)))
    return entries.join(delta, "sha256", "left").withColumn("pins", owners).drop("_add", "_drop")


def reconcile(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """What an inventory finds: entries without a file, files without an entry, differing sizes, and agreement."""
    m = metadata.select(F.col("sha256"), F.col("size").alias("_m"))
    both = m.join(files.select("sha256", F.col("size").alias("_f")), "sha256", "full_outer")
    state = F.when(F.col("_f").isNull(), "file-missing").when(F.col("_m").isNull(), "orphan-file").when(F.col("_m") != F.col("_f"), "size-differs").otherwise("ok")
    return both.select("sha256", state.alias("state"))


#: Owners that last as long as a lock is held, those of packages and of transfers, the host's own, and that of what nobody recognises.
LIFETIME = r"^(?:reader-v2|snapshot-v2)/([0-9a-f]{64})$"
PACKAGE = r"^package/([0-9a-f]{64})/([0-9a-f]{64})$"
TRANSFER = r"^transfers/[0-9a-f]{64}/(up|down)/([0-9a-f]{64})$"
HOST, RECOVERED = "app/", "recovered/unknown"


def inventory(entries: DataFrame, files: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """The entries (sha256, bytes, owners) after both inventories were compared: those known, and those of whole files without an entry.

    entries: sha256, bytes, owners (array); files: sha256, size (null: not whole), partial (bytes of an unfinished one);
    lifetimes: name of each lock that is held. Owners whose lock nobody holds are removed, bytes become those on disk
    (not fewer than before while readers remain), and a file that no entry knows gets an owner that keeps it.
    """
    each = entries.select("sha256", F.posexplode("owners").alias("_at", "_owner"), F.regexp_extract(F.col("_owner"), LIFETIME, 1).alias("_name"))
    held = lifetimes.select(F.col("name").alias("_held")).distinct()
    timed = each.filter("_name != ''").join(held, F.col("_name") == F.col("_held"), "left_semi")
    kept = each.filter("_name = ''").unionByName(timed).groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("_at", "_owner"))).getField("_owner").alias("_owners"))
    known = entries.select("sha256", F.col("bytes").alias("_bytes"), F.lit(True).alias("_known")).join(kept, "sha256", "left")
    both = known.join(files.select("sha256", F.col("size").alias("_size"), F.col("partial").alias("_partial")), "sha256", "full_outer").filter("_known OR _size IS NOT NULL")
    owners = F.when(F.col("_known"), F.coalesce("_owners", F.array().cast("array<string>"))).otherwise(F.array(F.lit(RECOVERED)))
    on_disk = (F.coalesce("_size", F.lit(0)) + F.coalesce("_partial", F.lit(0))).cast("long")
    read = F.exists("owners", lambda o: o.startswith("reader-v2/"))
    return both.withColumn("owners", owners).select("sha256", F.when(read, F.greatest(on_disk, F.col("_bytes"))).otherwise(on_disk).cast("long").alias("bytes"), "owners")


def owner_states(entries: DataFrame, lifetimes: DataFrame, manifests: DataFrame, pointers: DataFrame, transfers: DataFrame, cleanups: DataFrame, repairs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(sha256, owner, resolution) of every owner of the entries: live, released, unknown or unavailable.

    manifests: package, revision (digests of the record's key), package_id, revision_id, items (array of digests; null: unreadable);
    pointers: package, payload (a revision's name); transfers: key, sha256, size, direction, schema; cleanups: key, payload;
    repairs: key, sha256, state, schema; hosts: sha256, owner, resolution. Only what is proven gone is released. Each kind of
    owner meets its own table alone, so those of other kinds don't pile up under an empty key.
    """
    each = entries.select("sha256", F.explode("owners").alias("owner"))
    owner = F.col("owner")
    kind = F.when(owner.rlike(LIFETIME), "lifetime").when(owner.rlike(PACKAGE), "package").when(owner.rlike(TRANSFER) & owner.endswith(F.col("sha256")), "transfer").when(owner.startswith(HOST), "host").otherwise("other")
    of = lambda k: each.filter(kind == k)
    told = lambda found: found.select("sha256", "owner", F.col("resolution"))

    held = lifetimes.select(F.col("name").alias("_name"), F.lit(True).alias("_held")).distinct()
    timed = of("lifetime").join(held, F.regexp_extract(owner, LIFETIME, 1) == F.col("_name"), "left")
    timed = timed.withColumn("resolution", F.when(F.col("_held"), "live").otherwise("released"))

    at = {"_package": F.regexp_extract(owner, PACKAGE, 1), "_revision": F.regexp_extract(owner, PACKAGE, 2)}
    m = manifests.select(F.col("package").alias("_package"), F.col("revision").alias("_revision"), F.lit(True).alias("_there"), "items", ((F.sha2("package_id", 256) == F.col("package")) & (F.sha2("revision_id", 256) == F.col("revision"))).alias("_true"))
    text = F.col("payload")
    p = pointers.groupBy(F.col("package").alias("_package")).agg(F.bool_or(text.isNull() | (F.trim(text) == "") | (F.length(text) > 256)).alias("_odd"), F.collect_set(F.sha2(text, 256)).alias("_named"))
    packed = of("package").withColumns(at).join(m, ["_package", "_revision"], "left").join(p, ["_package"], "left")
    named = F.coalesce(F.col("_odd") | F.array_contains("_named", F.col("_revision")), F.lit(False))
    packed = packed.withColumn("resolution", F.when(F.col("_there"), F.when(F.col("_true") & F.array_contains("items", F.col("sha256")), "live").otherwise("unknown")).when(named, "unknown").otherwise("released"))

    t = transfers.select(F.col("key").alias("owner"), F.struct("sha256", "size", "direction", "schema").alias("_job"))
    c = cleanups.select(F.col("key").alias("owner"), F.struct("payload").alias("_cleanup"))
    r = repairs.select(F.col("key").alias("owner"), F.struct("sha256", "state", "schema").alias("_repair"))
    sent = of("transfer").join(t, "owner", "left").join(c, "owner", "left").join(r, "owner", "left")
    job, repair = (lambda f: F.col(f"_job.{f}")), (lambda f: F.col(f"_repair.{f}"))
    sound = (job("schema") == 1) & (job("sha256") == F.col("sha256")) & (job("size") >= 0) & (job("direction") == F.regexp_extract(owner, TRANSFER, 1))
    mended = (repair("schema") == 1) & (repair("state") == "completed") & (repair("sha256") == F.col("sha256"))
    uncertain = F.col("_cleanup").isNotNull() & ~F.col("_cleanup.payload").eqNullSafe(F.lit("1"))
    sent = sent.withColumn("resolution", F.when(F.col("_job").isNotNull(), F.when(sound, "live").otherwise("unknown")).when(uncertain, "unknown").when(F.col("_repair").isNull() | mended, "released").otherwise("unknown"))

    asked = of("host").join(hosts.select("sha256", "owner", "resolution"), ["sha256", "owner"], "left").withColumn("resolution", F.coalesce("resolution", F.lit("unknown")))
    rest = of("other").withColumn("resolution", F.lit("unknown"))
    return told(timed).unionByName(told(packed)).unionByName(told(sent)).unionByName(told(asked)).unionByName(told(rest))


def maintained(entries: DataFrame, states: DataFrame) -> DataFrame:
    """The entries without the owners that are released, in their order."""
    gone = states.filter("resolution = 'released'").groupBy("sha256").agg(F.collect_set("owner").alias("_gone"))
    left = F.array_except("owners", F.coalesce("_gone", F.array().cast("array<string>")))
    return entries.join(gone, "sha256", "left").withColumn("owners", F.when(F.col("_gone").isNull(), F.col("owners")).otherwise(left)).drop("_gone")


def maintenance_totals(entries: DataFrame, states: DataFrame) -> DataFrame:
    """One row: owners by resolution, and the bytes of entries that some owner still protects."""
    n = lambda r: F.count_if(F.col("resolution") == r)
    counts = states.agg(F.count(F.lit(1)).alias("examined"), n("live").alias("live"), n("released").alias("released"), n("unknown").alias("unknown"), n("unavailable").alias("unavailable"))
    kept = maintained(entries, states).agg(F.coalesce(F.sum(F.when(F.size("owners") > 0, F.col("bytes"))), F.lit(0)).alias("protected_bytes"))
    return counts.crossJoin(F.broadcast(kept))  # one row each


def chunks(blobs: DataFrame, content: str, chunk_bytes: int) -> DataFrame:
    """Chunks of each blob: id, chunk (from 0), bytes, sha256. An empty blob has none. Chunks are cut and hashed in the blob's row, so none is multiplied."""
    data = F.col(content).cast("binary")
    n = F.ceil(F.octet_length(data) / chunk_bytes).cast("int")
    part = lambda i: F.substring(data, i * chunk_bytes + 1, F.lit(chunk_bytes))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk"), F.octet_length(part(i)).alias("bytes"), F.sha2(part(i), 256).alias("sha256")))
    return blobs.filter(F.octet_length(data) > 0).select("id", F.explode(cut).alias("c")).select("id", "c.*")


def chunk_map(sizes: DataFrame, chunk_bytes: int) -> DataFrame:
    """Offsets and lengths of each blob's chunks, from its size alone."""
    n = F.ceil(F.col("size") / chunk_bytes).cast("int")
    cut = sizes.filter(F.col("size") > 0).select("id", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    at = F.col("chunk").cast("long") * chunk_bytes
    return cut.select("id", "chunk", at.alias("offset"), F.least(F.lit(chunk_bytes).cast("long"), F.col("size") - at).alias("length"))


def scrub(mapped: DataFrame, stored: DataFrame) -> DataFrame:
    """State of each chunk by its map and the store: ok, missing, damaged; and orphans, which no map names."""
    s = stored.select("id", "chunk", F.col("sha256").alias("_s"))
    both = mapped.select("id", "chunk", F.col("sha256").alias("_m")).join(s, ["id", "chunk"], "full_outer")
    state = F.when(F.col("_m").isNull(), "orphan").when(F.col("_s").isNull(), "missing").when(F.col("_m") != F.col("_s"), "damaged").otherwise("ok")
    return both.select("id", "chunk", state.alias("state"))


def next_transfers(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Jobs to run next: runnable and due; priority first, then fewest attempts, then key."""
    due = jobs.filter(F.col("state").isin(*RUNNABLE) & (F.col("due_at").isNull() | (F.col("due_at") <= now)))
    return due.orderBy(F.col("priority").desc(), "attempts", "key").limit(limit)


def transfer_step(jobs: DataFrame, results: DataFrame, most_attempts: int = 8) -> DataFrame:
    """State of each job after its attempt: done, waiting again, failed for good, or untouched."""
    r = results.select(F.col("key").alias("_k"), "result")
    joined = jobs.join(r, F.col("key") == F.col("_k"), "left")
    attempts = F.col("attempts") + F.when(F.col("result") == "transient", 1).otherwise(0)
    state = (
        F.when(F.col("result") == "ok", "completed").when(F.col("result") == "permanent", "failed").when((F.col("result") == "transient") & (attempts >= most_attempts), "failed")
        .when(F.col("result") == "transient", "waiting").otherwise(F.col("state"))
    )
    return joined.select("key", state.alias("state"), attempts.cast("long").alias("attempts"))


def assemble(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Finish uploads: parts (id, offset, data) put together where they are gapless and match (id, sha256, size).

    An upload is bounded in chunks, so its parts meet in one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "data")))
    joined = parts.groupBy("id").agg(ordered.alias("p"))
    ends = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("end"), F.lit(True).alias("ok")), lambda s, x: F.struct((s["end"] + F.octet_length(x["data"])).alias("end"), (s["ok"] & (x["offset"] == s["end"])).alias("ok")))
    content_ = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))  # each byte is copied a few times, however many parts
    put = joined.select("id", ends.alias("e"), content_.alias("content"))
    done = put.join(expected.select(F.col("id").alias("_i"), "sha256", "size"), F.col("id") == F.col("_i"))
    state = (
        F.when(~F.col("e.ok"), "gap").when(F.col("e.end") < F.col("size"), "incomplete").when((F.col("e.end") > F.col("size")) | (F.sha2("content", 256) != F.col("sha256")), "invalid").otherwise("complete")
    )
    return done.select("id", state.alias("state"), F.when(state == "complete", F.col("content")).alias("content"))


def read_range(blobs: DataFrame, content_col: str, start: Column, length: Column) -> Column:
    """Bytes of a range; beyond the end there are none."""
    return F.substring(F.col(content_col).cast("binary"), start + 1, length)


def seal(content_col: Column, key: Column, owner: Column) -> Column:
    """An envelope that only opens with the same key for the same owner (AES-GCM; the owner is authenticated)."""
    return F.aes_encrypt(content_col, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), owner)


def opened(envelope: Column, key: Column, owner: Column) -> Column:
    """The content of an envelope; null where key or owner don't fit."""
    return F.try_aes_decrypt(envelope, key, F.lit("GCM"), F.lit("DEFAULT"), owner)
