"""One-permutation MinHash fingerprints with built-in functions only.

Each text is cut into words at ASCII white space and hashed as shingles of five words, once: the hash's upper bits
name a bin, which keeps the least of its hashes. An empty bin takes the value of the first
non-empty bin in its own fixed random order of all bins (optimal densification: which bin lends depends on the
borrower alone). Of every bin the lowest `bits` bits are stored, packed as hexadecimal digits. The likeness of
two fingerprints is the share of equal bins, corrected for the 2^-bits of bins that agree by chance.

A text of fewer than five words is one shingle. Texts without words share the fingerprint of no shingle, all
zero digits, whose likeness is 1 with itself and 0 with any other. Equal texts have equal fingerprints. Rows
that repeat are fingerprinted each; other columns are ignored; an empty table gives an empty result. Rows without an id come
last, and rows of one id in the order of their texts (of a crowded id, see with_next: of their digests).
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType

from tidemark.llm._common import GAP, let, stored

BINS, BITS, SHINGLE, PROBES = 128, 8, 5, 8
#: An id with as many ranges' rows holds at least two of the ranges' bounds, however these are estimated.
CROWDED = 3
#: Columns that with_next adds: range of ids, part of a crowded id, lot of equal rows, and the order of a crowded id's rows.
PLACE = ["bucket", "sub", "copy", "tie"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Array of 64-bit hashes: of each word first, then of each run of n words."""

    def runs(h: Column) -> Column:
        size = F.size(h)
        at = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n)))
        whole = F.array(F.xxhash64(F.concat_ws(" ", F.transform(h, lambda x: x.cast("string")))))
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), at)).when(size > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def _literal(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def probe_orders(bins: int, probes: int, seed: int) -> list[list[int]]:
    """For each bin, the first bins of its own random order of the others."""
    rng = random.Random(seed)
    return [rng.sample([j for j in range(bins) if j != i], min(probes, bins - 1)) for i in range(bins)]


def signature(hashes: Column, bins: int = BINS, probes: int = PROBES, seed: int = 5) -> Column:
    """Array of `bins` hashes, the least of each bin or what it borrows, from an array of hashes; null if that is empty.

    Sorted, the hashes of a bin lie together with the least first, so one pass over neighbours finds the minima.
    A bin's borrowing order is a table for the first probes and by a hash of both bins for the rest. Bins are
    in the order in which signed numbers sort: the upper half first.
    """
    shift = 64 - (bins - 1).bit_length()
    order = probe_orders(bins, probes, seed)
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")

    def minima(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))

    def dense(found: Column) -> Column:
        def filled(where: Column) -> Column:
            at = lambda b: F.get(found, F.array_position(where, b).cast("int") - 1)

            def value(b: Column) -> Column:
                lent = [at(F.get(_literal([o[k] for o in order]), b)) for k in range(len(order[0]))]
                rest = F.array_min(F.transform(found, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("o"), h.alias("h"))))["h"]
                return F.coalesce(at(b), *lent, rest)

            return F.transform(_literal([*range(bins // 2, bins), *range(bins // 2)]), value)

        return F.when(F.size(found) == bins, found).otherwise(let(F.transform(found, bin_of), filled))

    return F.when(F.size(hashes) > 0, let(let(F.sort_array(hashes), minima), dense))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> Column:
    """The packed low bits (a multiple of four) of the text's signature, as hexadecimal digits."""
    digits = bits // 4

    def packed(values: Column) -> Column:
        low = F.transform(values, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit((1 << bits) - 1))), digits, "0")))
        return F.coalesce(F.array_join(low, ""), F.lit("0" * digits * bins))

    return let(let(shingle_hashes(text, shingle), lambda h: signature(h, bins)), packed)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    digits, chance, none = bits // 4, 2.0**-bits, F.lit("0" * (bits // 4) * bins)
    part = lambda s, i: F.substring(s, i * digits + 1, digits)
    same = F.size(F.filter(_literal(list(range(bins))), lambda i: part(a, i) == part(b, i)))
    estimate = (same / F.lit(float(bins)) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((a == none) | (b == none), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), estimate))


def _bucket(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most x, by binary search; -1 for null."""
    if not bounds:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*map(F.lit, bounds))
    found = F.aggregate(_literal(steps), F.lit(0), lambda low, s: F.when(F.get(table, low + s - 1) <= x, low + s).otherwise(low))
    return F.when(x.isNull(), F.lit(-1)).otherwise(found)


def _quantiles(docs: DataFrame, id_col: str, n: int, buckets: int) -> list:
    """Bounds of about equal counts, sorted; an id that holds several of them is there as often."""
    cuts = [i / buckets for i in range(1, buckets)]
    if isinstance(docs.schema[id_col].dataType, NumericType):
        got = docs.select(F.percentile_approx(id_col, cuts, max(10_000, 10 * buckets))).first()[0] or []
    else:  # where ids aren't numbers, the ranges' bounds come from a sample; the rows are all there
        drawn = sorted(x[0] for x in docs.select(id_col).sample(min(1.0, 10 * buckets / n), seed=5).collect() if x[0] is not None)
        got = [drawn[int(c * len(drawn))] for c in cuts] if drawn else []
    return sorted(x for x in got if x is not None)


def with_next(docs: DataFrame, values: dict[str, Column], id_col: str, bucket_rows: int = 2048, most_buckets: int = 20_000) -> tuple[DataFrame, WindowSpec]:
    """The rows (id, values, guard, place), and the window in which lead() gives the next row by descending id.

    The rows are dealt by ranges of ids of about equal counts (quantiles of the ids), at most most_buckets, in one
    shuffle. Each range ends with a guard: a copy of the first row of the range that follows; after the last comes the
    first. Drop the guards at the end. Rows of one id are in the order of the values.

    An id is crowded if it has CROWDED ranges' rows or more (so has null, where as many rows lack an id). Its rows come in the
    order of a digest of the values, and are split by ranges of that. Those that repeat follow themselves, all but the last of
    them: they are counted, and laid out in lots of bucket_rows that end with themselves. So no range grows with an id.
    """
    n, filled = docs.select(F.count(F.lit(1)), F.count(id_col)).first()
    buckets = max(1, min(most_buckets, -(-n // bucket_rows)))
    got = _quantiles(docs, id_col, n, buckets) if buckets > 1 else []
    bounds = sorted(set(got))
    many = CROWDED * max(bucket_rows, -(-n // buckets))
    several = [x for x, k in Counter(got).items() if k > 1]
    crowded = [x for x, k in docs.filter(F.col(id_col).isin(several)).groupBy(id_col).count().collect() if k >= many] if several else []
    many_null = n - filled >= many
    in_crowd = lambda x: F.when(x.isNull(), F.lit(many_null)).otherwise(x.isin(crowded) if crowded else F.lit(False))
    # Ranges by descending id are numbered 0, 2, 4 ..., null last; a crowded id is the least of its range and has a place after it.
    last = 2 * (len(bounds) + 1)
    bucket = F.lit(last - 2) - 2 * _bucket(F.col("id"), bounds)
    some = bool(crowded) or many_null
    part_of = lambda sub: [sub.cast("long").alias("sub"), F.lit("").alias("copy"), F.lit(0).cast("long").alias("tie")] if some else []

    rows = docs.select(F.col(id_col).alias("id"), *(v.alias(k) for k, v in values.items()))
    ids = docs.select(F.col(id_col).alias("id"))
    if some:
        rows, ids, crowd = rows.filter(~in_crowd(F.col("id"))), ids.filter(~in_crowd(F.col("id"))), rows.filter(in_crowd(F.col("id")))
    firsts = {b: x for b, x in ids.groupBy(bucket.alias("b")).agg(F.max("id")).collect()}
    ends = dict.fromkeys(firsts, 0)  # the last part of each place
    if some:
        crowd = stored(crowd.groupBy("id", *values).agg(F.count(F.lit(1)).alias("times")).withColumn("tie", F.xxhash64(*values)), "crowd")
        sizes = crowd.groupBy(F.col("id").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("parts"))  # a row a crowded id, at most most_buckets
        part = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.col("parts") - 1)
        crowd = crowd.join(F.broadcast(sizes), F.col("id").eqNullSafe(F.col("_of"))).select("id", *values, "times", (bucket + 1).alias("bucket"), part.cast("long").alias("sub"), "tie")
        heads = stored(crowd.groupBy("bucket", "sub").agg(F.max("id").alias("id"), F.min(F.struct("tie", *values)).alias("v")), "crowd-heads")
        ends |= {b: e for b, e in heads.groupBy("bucket").agg(F.max("sub")).collect()}
    order = sorted(ends)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # of the first: the last
    of = lambda found: F.get(_literal([found.get(b, 0) for b in range(last + 2)]), F.col("own"))
    before_bucket, before_end = of(before), of({b: ends[x] for b, x in before.items()})

    starts = F.col("id").isin([x for x in firsts.values() if x is not None]) | (F.col("id").isNull() if None in firsts.values() else F.lit(False))
    least = rows.filter(starts).groupBy("id").agg(F.min(F.struct(*values)).alias("v")).withColumn("own", bucket)
    unpacked = ["id", *(F.col("v")[k].alias(k) for k in values), F.lit(True).alias("guard")]
    dealt = rows.select("*", F.lit(False).alias("guard"), bucket.alias("bucket"), *part_of(F.lit(0)))
    dealt = dealt.unionByName(least.select(*unpacked, before_bucket.alias("bucket"), *part_of(before_end)))
    if some:
        parts = Window.partitionBy("own").orderBy("sub")  # slim: a row for bucket_rows rows
        prior = heads.select(F.col("bucket").alias("own"), "sub").withColumn("prior", F.lag("sub").over(parts))
        led = heads.withColumnRenamed("bucket", "own").join(prior, ["own", "sub"])
        led = led.select(*unpacked, F.when(F.col("prior").isNull(), before_bucket).otherwise(F.col("own")).alias("bucket"), *part_of(F.coalesce("prior", before_end)))
        once = crowd.select("id", *values, F.lit(False).alias("guard"), "bucket", "sub", F.lit("").alias("copy"), "tie")
        lot = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 2) / bucket_rows)))
        named = F.md5(F.to_json(F.struct("id", *values)).cast("binary"))
        lots = crowd.filter("times > 1").withColumn("name", named).withColumn("lot", lot).withColumn("copy", F.concat_ws(":", "name", "lot")).repartition("copy")
        held = F.least(F.lit(bucket_rows), F.col("times") - 1 - F.col("lot") * bucket_rows).cast("int")
        again = lots.select("id", *values, F.explode(F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), held))).alias("guard"), "bucket", "sub", "copy", "tie")
        dealt = dealt.unionByName(led).unionByName(once).unionByName(again)
    tie = ["tie"] if some else []
    return dealt, Window.partitionBy("bucket", *(["sub", "copy"] if some else [])).orderBy("guard", F.col("id").desc_nulls_last(), *tie, *values)


def fingerprint_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and that of the next document's text.

    The edited text has the last third (rounded down, in code points) replaced by as many code points, or all, from
    the start of the next document by descending id. Returns id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited and near_next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt, window = with_next(docs, {"text": text}, id_col)
    place = [c for c in dealt.columns if c in PLACE]
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("following"), F.lit(1), third))
    marked = (
        dealt.withColumn("following", F.lead("text").over(window))
        .select("*", edited.alias("edited_text"), F.length("text").cast("long").alias("n_chars"))
        .select("id", "guard", *place, "text", "n_chars", "edited_text", fingerprint(F.col("text"), bins, bits, shingle).alias("fingerprint"), F.when(~F.col("guard"), fingerprint(F.col("edited_text"), bins, bits, shingle)).alias("edited_fingerprint"))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(window))
    )
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), bins, bits)
    return marked.filter(~F.col("guard")).select(
        F.col("id").alias(id_col), "n_chars", "edited_text", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next")
    )
