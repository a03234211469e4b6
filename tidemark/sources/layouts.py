"""Stored layouts that answer pages by pruning: declared indexes sorted by a binary key, and feeds bucketed by version.

An index is a table of entries (index, key, at, id) range-partitioned and sorted by `at`, the UTF-16BE bytes of key and id. Their
byte order is the ordinal order of UTF-16 units that pages have, which text columns of Parquet don't. Bounds and cursors
are comparisons of `at` with a literal, pushed to the scan: row groups whose statistics lie outside aren't read, and since files
hold disjoint ranges, most files end at their footer. A page reads the files that its range meets, not the table.

A feed is laid out by bucket of its versions, `width` apart, as partition folders: a cursor's page reads the buckets
from its position on, and pages for many cursors join positions with buckets before they join rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of a bucket of a feed.
WIDTH = 65_536


def ordinal(text: Column) -> Column:
    """Bytes whose order is that of the text's UTF-16 units."""
    return F.encode(text, "UTF-16BE")


def entry_key(key: Column, i: Column | None = None) -> Column:
    """Bytes in the order of (key, id): the key's, a zero unit that ends it, and the id's. Keys hold no zero unit, ids neither."""
    return ordinal(F.concat(key, F.lit("\u0000"), i) if i is not None else key)


def write_index(entries: DataFrame, path: str, files: int | None = None, rows_a_group: int | None = None) -> None:
    """Store entries (index, key, id) sorted by (index, key, id), a folder an index; files is the number of ranges, those of the shuffle where it isn't given."""
    laid = entries.select("index", "key", "id", entry_key(F.col("key"), F.col("id")).alias("at"))
    by = [F.col("index"), F.col("at")]
    ranged = (laid.repartitionByRange(files, *by) if files else laid.repartitionByRange(*by)).sortWithinPartitions(*by)
    writer = ranged.write.partitionBy("index")
    if rows_a_group:
        writer = writer.option("parquet.block.row.count.limit", rows_a_group)
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, id string, at binary, index string").parquet(path)


def index_range(stored: DataFrame, index: str, low: str | None = None, high: str | None = None, low_inclusive: bool = True, high_inclusive: bool = True, after: tuple[str, str] | None = None, before: tuple[str, str] | None = None) -> DataFrame:
    """The entries of an index between two key tokens and beyond a cursor (key, id): `after` upwards, `before` downwards.

    All bounds are literals in the order of `at`, so the scan takes them. A key's entries begin with its bytes and a zero unit.
    """
    found, at = stored.filter(F.col("index") == index), F.col("at")
    bytes_of = lambda text: F.lit(bytearray(text.encode("utf-16-be")))
    if low is not None:
        found = found.filter(at >= bytes_of(low + "\u0000") if low_inclusive else at >= bytes_of(low + "\u0001"))
    if high is not None:
        found = found.filter(at < bytes_of(high + "\u0001") if high_inclusive else at < bytes_of(high + "\u0000"))
    if after is not None:
        found = found.filter(at > bytes_of("\u0000".join(after)))
    if before is not None:
        found = found.filter(at < bytes_of("\u0000".join(before)))
    return found


def index_page(stored: DataFrame, index: str, limit: int, descending: bool = False, **bounds) -> DataFrame:
    """A page of an index's entries in order; bounds as of index_range."""
    found = index_range(stored, index, **bounds)
    return found.orderBy(F.col("at").desc() if descending else F.col("at")).limit(limit).select("key", "id")


def index_count(stored: DataFrame, index: str, **bounds) -> DataFrame:
    return index_range(stored, index, **bounds).agg(F.count(F.lit(1)).alias("n"))


def write_feed(docs: DataFrame, path: str, scope: str = "scope", version: str = "version", width: int = WIDTH) -> None:
    """A feed laid out for pulling: a folder a scope and bucket of versions, within files in version order."""
    laid = docs.withColumn("bucket", F.floor(F.col(version) / width).cast("long"))
    laid.repartition(F.col(scope), F.col("bucket")).sortWithinPartitions(scope, "bucket", version).write.partitionBy(scope, "bucket").parquet(path)


def pull_page(stored: DataFrame, scope: str, since: int, limit: int, version: str = "version", width: int = WIDTH) -> DataFrame:
    """The rows after a position of one scope's feed, at most limit: buckets before the position aren't listed, row groups before it not read."""
    found = stored.filter((F.col("scope") == scope) & (F.col("bucket") >= since // width) & (F.col(version) > since))
    return found.orderBy(version).limit(limit).drop("bucket")


def pages(stored: DataFrame, cursors: DataFrame, limit: int, version: str = "version", width: int = WIDTH) -> DataFrame:
    """Pages for many cursors (cursor, scope, since) at once: cursor and the feed's columns, with has_more and checkpoint.

    How many rows each bucket holds is counted once, slim; from that follows, by cursor, up to which bucket a page and one row
    more can reach. Only those buckets' rows meet the cursor, and of these WindowGroupLimit keeps limit + 1 in each task before
    they are shuffled. A cursor without rows beyond it, or without a scope that exists, is one row of nulls with its own
    position as checkpoint.
    """
    counts = stored.groupBy(F.col("scope").alias("_s"), F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("_upto", F.sum("_n").over(upto))
    first = F.floor(F.col("since") / width)
    places = cursors.select("cursor", F.col("scope").alias("_scope"), F.col("since").cast("long").alias("since"))
    met = places.join(summed, (F.col("_scope") == F.col("_s")) & (F.col("_b") >= first))
    # The rows of the cursor's own bucket may all lie before it, so they don't count; enough is what the buckets behind it hold.
    behind = Window.partitionBy("cursor").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    needed = met.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_b") > first, F.col("_n")).otherwise(0)).over(behind), F.lit(0))).filter(F.col("_before") <= limit)
    slim = stored.select(F.col("scope").alias("_s"), F.col("bucket").alias("_b"), F.col(version).alias("_v"))
    beyond = needed.select("cursor", "since", "_s", "_b").join(slim, ["_s", "_b"]).filter(F.col("_v") > F.col("since"))
    ranked = beyond.withColumn("_r", F.row_number().over(Window.partitionBy("cursor").orderBy("_v"))).filter(F.col("_r") <= limit + 1)
    facts = ranked.groupBy(F.col("cursor").alias("_c")).agg(F.max(F.when(F.col("_r") <= limit, F.col("_v"))).alias("checkpoint"), (F.count(F.lit(1)) > limit).alias("has_more"))
    rows = ranked.filter(F.col("_r") <= limit).select("cursor", "_s", "_b", "_v").join(
        stored.withColumnsRenamed({"scope": "_rs", "bucket": "_rb"}), (F.col("_s") == F.col("_rs")) & (F.col("_b") == F.col("_rb")) & (F.col("_v") == F.col(version)))
    own = [c for c in stored.columns if c not in ("scope", "bucket")]
    whole = places.join(facts, F.col("cursor") == F.col("_c"), "left").select(F.col("cursor").alias("_c"), F.col("_scope").alias("scope"), F.coalesce("checkpoint", "since").alias("checkpoint"), F.coalesce("has_more", F.lit(False)).alias("has_more"))
    return whole.join(rows.select("cursor", *own), F.col("_c") == F.col("cursor"), "left").select(F.col("_c").alias("cursor"), "scope", *own, "has_more", "checkpoint")
