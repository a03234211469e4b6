"""Near-duplicate classes by SimHash, with links found by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius; two fingerprints within the radius then share a
variant, on which they meet after a shuffle. Balls of 64 bits and radius 4 have 2081 members, so the fingerprint
is first halved: of two within 4 bits, some half differs in at most 2, and the balls of half that radius around
32-bit halves have 33 members. What meets on a half is verified on all 64 bits.

Only distinct fingerprints take part, so copies cost nothing. Fingerprints that meet on one variant come in a
sorted run; a run of up to `run_rows` is verified there, and only links from each of its members to the least of
its class leave the task. Members of a longer run go on to whole 64-bit balls instead, where whatever shares a
variant is within the radius by construction, so linking each to the least needs no pairs: no link is lost.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; rows that repeat
get the same class; null ids never name a class unless it has no other id; empty tables and extra columns are fine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_if_small, id_type, map_batches, stored
from tidemark.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """SimHash of 64-bit hashes: a bit is set if more than half of them have it; zero if there are none."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        votes += np.unpackbits(hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased: a bit is set if more than half of the shingles' XXH64 have it."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    votes, n, step = np.zeros(64, dtype=np.int64), len(words) - shingle + 1, 1 << 16
    for i in range(0, n, step):
        j = min(n, i + step)
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)]
        votes += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([text_fingerprint(t, shingle, seed) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64), "text_hash": batch["text_hash"]})

    rows = map_batches(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), run, "id string, fp long, text_hash long")
    return rows.select(F.col("id").cast(id_type(docs, id_col)).alias("id"), "fp", "text_hash")


def _masks(width: int, most: int) -> list[int]:
    """Every number of `width` bits with at most `most` of them set (most up to 2)."""
    one = [1 << i for i in range(width)]
    return [0, *one * (most > 0), *(a | b for i, a in enumerate(one) for b in one[:i] if most > 1)]


def _array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v - (1 << 64) if v >> 63 else v}L' for v in values)})")


def ball(fp: Column, radius: int = RADIUS) -> Column:
    """All 64-bit variants within half the radius."""
    return F.transform(_array(_masks(64, -(-radius // 2))), lambda m: fp.bitwiseXOR(m))


def half_balls(fp: Column, radius: int = RADIUS) -> Column:
    """The variants of both 32-bit halves within a quarter of the radius; bit 32 tells the halves apart."""
    masks = _array(_masks(32, -(-(radius // 2) // 2)))
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))


def _verify(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, least of its class) in a run of distinct fingerprints; compares row by row, holding one row's distances."""
    n = len(run)
    if n == 2:
        return [(int(max(run)), int(min(run)))] if int(np.bitwise_count(run[0] ^ run[1])) <= radius else []
    run = np.sort(run)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(run[i + 1 :] ^ run[i]) <= radius) + i + 1
        if len(near):
            roots = np.unique(root[np.append(near, i)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return [(int(run[i]), int(run[r])) for i, r in enumerate(root.tolist()) if i != r]


def meet(radius: int, run_rows: int):
    """mapInPandas function over rows (key, fp) sorted by key: links (a, b), and (a, null) for members of long runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, long_run = np.empty(0, dtype=np.uint64), None, False
        for batch in batches:
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(keys):
                continue
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            sizes = np.diff(np.append(starts, len(keys)))
            links: list[tuple[int, int]] = []
            far: list[np.ndarray] = []
            first_continues = key is not None and keys[0] == key
            if not first_continues and len(held) > 1 and not long_run:
                links += _verify(held, radius)
            # All runs but the first and the last are whole in this batch; only those of several rows matter.
            for j in [0, *(np.flatnonzero(sizes[1:-1] > 1) + 1).tolist(), *[len(starts) - 1] * (len(starts) > 1)]:
                part = fps[starts[j] : starts[j] + sizes[j]]
                if j == 0 and first_continues:
                    if long_run:
                        far.append(part)
                        part = part[:0]
                    else:
                        part = np.concatenate((held, part))
                is_long = (j == 0 and first_continues and long_run) or len(part) > run_rows
                if is_long:
                    far.append(part)
                    part = part[:0]
                if j == len(starts) - 1:
                    held, key, long_run = part, keys[-1], is_long
                elif len(part) > 1:
                    links += _verify(part, radius)
            a = [x for x, _ in links]
            b = pd.array([np.uint64(y).view(np.int64) for _, y in links] + [pd.NA] * sum(map(len, far)), dtype="Int64")
            yield pd.DataFrame({"a": np.concatenate([np.array(a, dtype=np.uint64), *far]).view(np.int64), "b": b})
        if len(held) > 1 and not long_run:
            links = _verify(held, radius)
            yield pd.DataFrame({"a": np.array([x for x, _ in links], dtype=np.uint64).view(np.int64), "b": np.array([y for _, y in links], dtype=np.uint64).view(np.int64)})

    return run


def links(fps: DataFrame, radius: int = RADIUS, run_rows: int = 2048) -> DataFrame:
    """(a, b): links whose components are those of all pairs within the radius. fps: one column fp, distinct.

    run_rows bounds what a task compares with one another; beyond it whole balls take over, so no link is lost.
    """
    met = fps.select("fp", F.explode(half_balls(F.col("fp"), radius)).alias("key")).repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
    found = stored(map_batches(met, meet(radius, run_rows), "a long, b long"), "met")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if crowded.limit(1).count() == 0:
        return found.distinct()
    # A member also links to fingerprints outside its long run; those meet it on the other half or in another run.
    variants = crowded.select("fp", F.explode(ball(F.col("fp"), radius)).alias("v"))
    least = variants.groupBy("v").agg(F.min("fp").alias("b"))
    more = variants.join(least, "v").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return found.filter("b is not null").union(more).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, run_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash, class_fp, class_id) of each row: class_id is the least id reachable over links of at most `radius` bits."""
    own = stored(fingerprints(docs, shingle, SEED, id_col, text_col), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, run_rows))
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    named = classed.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("class_id"))
    by_fp = classed.join(named, F.col("class") == F.col("c")).select(F.col("fp").alias("f"), F.col("class").alias("class_fp"), "class_id")
    return own.join(by_fp, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "text_hash", "class_fp", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The documents without all but one (that of the least id) of each class that find names; rows without an id stay."""
    found = find(docs, id_col=id_col, text_col=text_col, **options)
    found = stored(found.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "text_hash", "class_fp", "class_id"), "classes")
    heads = found.filter("id = class_id").groupBy(F.col("class_fp").alias("c")).agg(F.min("id").alias("head_id"), F.min("text_hash").alias("head"), F.count(F.lit(1)).alias("n"))
    repeated = stored(heads.filter("n > 1"), "repeated-heads")  # only where an id repeats
    gone = found.filter("id != class_id").select("id", "text_hash")
    some = repeated.limit(1).count() > 0
    if some:
        others = found.filter("id = class_id").join(repeated, F.col("class_fp") == F.col("c")).filter("text_hash != head")
        gone = gone.union(others.select("id", "text_hash"))
    gone = broadcast_if_small(stored(gone.distinct(), "gone"), broadcast_rows)
    # The documents' own columns, whatever their names, are kept apart from those made here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))
    kept = rows.join(gone, (F.col("row_id") == F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left_anti")
    if some:
        head = (F.col("row_id") == F.col("head_id")) & (F.col("row_hash") == F.col("head"))
        kept = kept.join(repeated, head, "left_anti").unionByName(kept.join(repeated, head, "left_semi").dropDuplicates(["row_id", "row_hash"]))
    return kept.select("row.*")
