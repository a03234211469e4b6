"""Near copies by SimHash and Jaccard: classes of texts whose sets of five-word shingles share 0.8 or more.

First, texts meet by op7's method: each set has a SimHash, and all within `RADIUS` of 64 bits are found by meet-in-the-middle
ball hashing (`simhash.links`). At a likeness of 0.8 about ten bits differ, which no ball reaches that is small enough to be laid
out. So texts also meet on bands of MinHash values: of two at the least likeness, one of `BANDS` bands of `ROWS` values agrees
but for 5 pairs in a million, and above it far fewer are lost. What meets either way is verified on the shingles
themselves, so no link rests on an estimate.

Only distinct shingle sets take part, so copies cost nothing. A run of texts that meet on a band is searched breadth
first over lists of the texts that hold a shingle: each reached text finds all its near copies in the run at once, and
the search ends when none is left, so a cluster yields a link a member and no table of pairs. Runs that have the same
members as another are verified once, and those beyond a bound are split (`linking`).

Defined cases: null, empty and blank texts have the empty set and are copies of each other; a text of fewer than five
words is one shingle; rows that repeat get the same class; null ids never name a class unless it has no other id;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm._common import broadcast_if_small, id_type, map_batches, stored
from tidemark.llm.components import components
from tidemark.llm.linking import RUN_ITEMS, RUN_ROWS, classes, links

SHINGLE, BANDS, ROWS, SEED, RADIUS = 5, 40, 6, 42, simhash.RADIUS


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of a text, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, k = np.concatenate(([0], ends[:-1] + 1)), min(shingle, len(words))
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return flips, factors | np.uint64(1)


def band_keys(shingles: np.ndarray, step: int = 512) -> list[int]:
    """A signed key for each band; none for the empty set."""
    import xxhash

    if not len(shingles):
        return []
    flips, factors = _mixers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), step):
        mixed = shingles[i : i + step] ^ flips
        mixed *= factors
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def set_name(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def simhash_members(distinct: DataFrame, radius: int = RADIUS, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, fp): sets that reach one another over SimHashes of at most `radius` differing bits have one key. distinct: (fp, sim), each set once."""
    sims = stored(distinct.groupBy(F.col("sim").alias("fp")).agg(F.count(F.lit(1)).alias("n")), "simhashes")
    roots = components(simhash.links(sims.select("fp"), radius, run_rows))
    # Different sets may have the same SimHash, which no link tells.
    met = sims.join(roots, F.col("fp") == F.col("node"), "left").filter("n > 1 OR root IS NOT NULL").select(F.col("fp").alias("_sim"), F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash")).alias("key"))
    return distinct.select("fp", "sim").join(met, F.col("sim") == F.col("_sim")).select("key", "fp")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS, run_items: int = RUN_ITEMS, bands: int = BANDS) -> DataFrame:
    """(id, fp, text_hash, class_fp, class_id) of each row: fp names the set of shingles, class_id is the least id reachable over links.

    With fewer bands fewer links are found between texts whose SimHashes are apart; with none, only those within `RADIUS` bits.
    """

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            fps = np.array([set_name(s) for s in sets], dtype=np.uint64).view(np.int64)
            sims = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps, "text_hash": batch["text_hash"], "sim": sims, "keys": [band_keys(s)[:bands] for s in sets], "empty": [not len(s) for s in sets]})

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": batch["fp"], "shingles": [shingle_set(t).tobytes() for t in batch["text"]]})

    kind = id_type(docs, id_col)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = map_batches(texts, named, "id string, fp long, text_hash long, sim long, keys array<long>, empty boolean")
    own = stored(rows.withColumn("id", F.col("id").cast(kind)), "shingle-sets")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").cast("string").alias("id"), "text_hash")).alias("one"), F.any_value("sim").alias("sim"), F.any_value("keys").alias("keys"), F.any_value("empty").alias("empty")), "distinct-sets")
    met = distinct.select("fp", F.explode("keys").alias("key"))
    runs = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).filter("n > 1")
    runs = stored(runs.groupBy("who", "n").agg(F.min("key").alias("key")).select("key"), "runs")
    on_bands = met.join(broadcast_if_small(runs, 1_000_000), "key").select("key", "fp")
    members = stored(simhash_members(distinct.filter("NOT empty"), run_rows=run_rows).unionByName(on_bands), "run-members")
    wanted = stored(members.select("fp").distinct().join(distinct, "fp").select("fp", F.col("one.id").alias("_id"), F.col("one.text_hash").alias("_hash")), "met-sets")
    again = texts.join(broadcast_if_small(wanted, 1_000_000), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("fp", "text")
    sets = map_batches(again, laid_out, "fp long, shingles binary").groupBy("fp").agg(F.any_value("shingles").alias("shingles"))
    sets = stored(sets.select("fp", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles"), "shingles")
    found = classes(own.select("id", "fp", "text_hash"), distinct, links(members, sets, run_rows, run_items))
    return found.select(F.col("id").alias(id_col), "fp", "text_hash", "class_fp", "class_id")
