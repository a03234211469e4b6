"""Mix sources to target weights by repeating documents, with built-in functions only.

One pass over the texts stores sizes and digests, slim. Their sums by source (partial sums before the shuffle, so a
hot source costs one row a task) give targets and repetition rates; each document gets floor(rate) copies and one
more with probability equal to the fraction, whatever its size, drawn from digests of seed, id, source and text, so reruns agree.

The draws are calibrated, so that a source's total comes near its target without favouring small documents: a source's
documents fall into strata of nearly equal sizes, each stratum takes the documents of the least digests, and how many is the
fraction of its count, rounded at random such that the roundings of a source, in the order of sizes, share one number drawn from
the source's digest. Within a stratum every document is as likely to be among the least, so each one's probability is the fraction.
The last digest taken is a threshold for the stratum: documents are held against it where they lie, and aren't shuffled.

Targets: the sources share the total size in proportion to their weights, none above max_rate times its own
size; what is above goes to the others by weight, again and again. The limit of that is min(max_rate * own,
level * weight), whose level follows from one running sum over the sources in the order of own / weight, one row a source in
one task.

Defined cases: a null text has size zero; a null source is a source of its own; a source without words has
rate zero; rows that repeat draw alike; a null id is drawn by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, broadcast_if_small, stored

#: Strata up to this many are joined by broadcast (some tens of bytes each), more by a shuffle.
BROADCAST_STRATA = 200_000
#: Leading hexadecimal digits of a digest that tell the lots apart in which a stratum is numbered.
LOT_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weight(rank: Column) -> Column:
    """1, 2, 3 and again, by the rank of the source (from 1)."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def source_rates(sized: DataFrame, weight: Callable[[Column], Column] = cycling_weight, max_rate: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) of a table with columns source and size; sources in code point order, null last."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: small however large the table is.
    ranked = own.withColumn("weight", weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).cast("double"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    level = (F.col("total") - F.lit(max_rate) * F.coalesce(F.col("capped"), F.lit(0))) / F.col("open")
    leveled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", capped)
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("own_level", level)
        .withColumn("place", F.row_number().over(by_ratio))
    )
    # The level is that of the first source, in this order, which stays below its own cap.
    free = F.when(F.col("own_level") * F.col("weight") <= F.lit(max_rate) * F.col("source_size"), F.struct("place", "own_level"))
    target = F.least(F.lit(max_rate) * F.col("source_size"), F.col("level") * F.col("weight"))
    return (
        leveled.withColumn("level", F.min(free).over(everything)["own_level"])
        .withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(max_rate), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def digest(seed: int, *parts: Column) -> Column:
    """Hexadecimal digest of seed and parts: the same in every run, on every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def unit(digest_: Column) -> Column:
    """A number in [0, 1) from a digest."""
    return F.conv(F.substring(digest_, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def stratum(size: Column) -> Column:
    """Sizes of equal binary length and equal first four binary digits: an eighth apart at most; ordered as the sizes."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 4))


def thresholds(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """(_source, _stratum, source_size, target, rate, last) of each stratum: the documents with digests up to last get a copy more."""
    rates = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    counts = stored(sized.groupBy(F.col("source").alias("_of"), "stratum").agg(F.count(F.lit(1)).alias("n")), "mixing-strata")
    upto = Window.partitionBy("_of").orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)
    fraction, first = F.col("rate") - F.floor("rate"), unit(digest(seed, F.coalesce(F.concat(F.lit("source "), "_source"), F.lit("none"))))
    taken = lambda n: F.floor(fraction * n + first)
    summed = counts.withColumn("upto", F.sum("n").over(upto)).join(broadcast_if_small(rates, BROADCAST_STRATA), F.col("_of").eqNullSafe(F.col("_source")))
    wanted = stored(summed.select("_source", F.col("stratum").alias("_stratum"), "source_size", "target", "rate", (taken(F.col("upto")) - taken(F.col("upto") - F.col("n"))).alias("wanted")), "mixing-wanted")
    own = F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum"))
    some = sized.join(broadcast_if_small(wanted.filter("wanted > 0"), BROADCAST_STRATA), own).select("_source", "_stratum", "wanted", "digest", F.substring("digest", 1, LOT_DIGITS).alias("lot"))
    # A lot starts where the counts of those before it end; only the lot in which the last digest lies is numbered.
    lots = some.groupBy("_source", "_stratum", "lot").agg(F.count(F.lit(1)).alias("k"), F.max("wanted").alias("wanted"))
    before = Window.partitionBy("_source", "_stratum").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    last_lots = stored(lots.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).filter("before < wanted and before + k >= wanted").select(F.col("_source").alias("_s"), F.col("_stratum").alias("_t"), F.col("lot").alias("_l"), "before"), "mixing-lots")
    there = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_stratum") == F.col("_t")) & (F.col("lot") == F.col("_l"))
    ranked = some.join(broadcast_if_small(last_lots, BROADCAST_STRATA), there).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_s", "_t").orderBy("digest")))
    last = ranked.filter("rank = wanted").select(F.col("_source").alias("_s"), F.col("_stratum").alias("_t"), F.col("digest").alias("last"))
    return wanted.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_stratum") == F.col("_t")), "left").drop("wanted", "_s", "_t")


def mix_plan(docs: DataFrame, seed: int = 23, weight: Callable[[Column], Column] = cycling_weight, max_rate: float = 3.0, size: Callable[[Column], Column] = word_count, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The documents with size, source_size, target, rate and copies (long). keep: columns to carry along, read once more."""

    def slim(*more: Column) -> DataFrame:
        rows = docs.select(*more, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), digest(seed, F.col(id_col), F.col(text_col)).alias("digest"))
        return rows.withColumn("stratum", stratum(F.col("size")))

    sized = stored(slim(), "mixing-sizes")
    rates = stored(source_rates(sized, weight, max_rate), "mixing-rates")
    drawn = stored(thresholds(sized, rates, seed), "mixing-thresholds")
    rows = slim(F.struct(*keep).alias("_kept")) if keep else sized
    joined = rows.join(broadcast_if_small(drawn, BROADCAST_STRATA), F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum")))
    more = F.coalesce(F.col("digest") <= F.col("last"), F.lit(False)).cast("long")
    return joined.select(
        *(["_kept"] if keep else []), F.col("id").alias(id_col), "size", "source_size", "target", "rate", (F.floor("rate") + more).cast("long").alias("copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as the mix takes it."""
    plan = mix_plan(docs, keep=docs.columns, **options).filter("copies > 0")
    return plan.select("_kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_kept.*")
