"""Near copies by an inverted join over MinHash signatures: classes of texts whose two-word shingle sets have a Jaccard of 0.8 or more.

A signature has `COORDINATES` MinHash values; a coordinate with its value is one token, so that every text has as many
tokens, and two texts share as many as their coordinates collide. At the least likeness that count is binomial, and under
`LEAST` of 64 in 4 of a billion pairs. The pairs above that threshold are found by an inverted join:

- Prefix: tokens are ordered by how many texts have them, rarest first. Texts that share `LEAST` tokens share one of the first
  64 - LEAST + 1, so only these are posted. A token of one text alone takes a place in the prefix and is never posted; a text with
  fewer than `LEAST` tokens that others have as well leaves here, which is most of a corpus.
- Skip: the long lists, at the end of the order, are never merged. What meets on a short list counts its collisions over all
  coordinates at once, by a byte of each, which may count too many, never too few.
- What is above the threshold is confirmed on the full sets (`linking`). A list longer than `run_rows` isn't compared by one task; its
  texts go to `linking` as they are, which splits it. So neither step drops or caps anything.

Only distinct sets take part: copies cost nothing. Sets of up to three shingles are near to equal sets alone.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing, each being its own class; a text of one
word is one shingle; rows that repeat (text and id) get the same class; a null id names a class only where no other id does;
a text of any length is taken whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_if_small, id_type, map_batches, stored
from tidemark.llm.linking import RUN_ITEMS, RUN_ROWS, classes, links
from tidemark.llm.near_copies import set_name, shingle_set

SHINGLE, COORDINATES, LEAST, SEED = 2, 64, 31, 12
#: Sets of fewer shingles have no near ones but equal ones.
LEAST_ITEMS = 4


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    flips, factors = np.random.default_rng(SEED).integers(0, 1 << 64, (2, COORDINATES, 1), dtype=np.uint64)
    return flips, factors | np.uint64(1)


def signature(shingles: np.ndarray, step: int = 512) -> np.ndarray:
    """The tokens of a set: 58 bits of each coordinate's least value, and 6 that name the coordinate."""
    flips, factors = _mixers()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), step):
        mixed = shingles[i : i + step] ^ flips
        mixed *= factors
        np.minimum(least, mixed.min(axis=1), out=least)
    return least & ~np.uint64(COORDINATES - 1) | np.arange(COORDINATES, dtype=np.uint64)


def _bytes_of(tokens: np.ndarray) -> bytes:
    """A byte of each coordinate's value, to count collisions by."""
    return (tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signed(tokens: bytes) -> list[int]:
    return np.frombuffer(tokens, dtype=np.int64).tolist()


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            shingles = shingle_set(text, SHINGLE)
            rows.append((set_name(shingles), len(shingles), signature(shingles).tobytes() if len(shingles) >= LEAST_ITEMS else None))
        fps = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"id": batch["id"], "text_hash": batch["text_hash"], "fp": fps, "n": np.array([r[1] for r in rows], dtype=np.int64), "signature": [r[2] for r in rows]})


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 1024):
            part = batch.iloc[k : k + 1024]
            yield pd.DataFrame({"fp": np.repeat(part["fp"].to_numpy(), COORDINATES), "token": np.frombuffer(b"".join(part["signature"]), dtype=np.int64)})


def collided(least: int, run_rows: int):
    """mapInPandas function over rows (token, fp, coded) sorted by token: (key, fp) of texts that collide with others of their list `least` times.

    What hangs together by such collisions gets one key, a hash of its members, so equal groups of other lists are told to be
    the same. Members of a list beyond run_rows get the token as their key, compared or not.
    """
    import xxhash

    def groups(fps: np.ndarray, coded: np.ndarray) -> list[tuple[int, int]]:
        left, out = np.ones(len(fps), dtype=bool), []
        for first in range(len(fps)):
            if not left[first]:
                continue
            left[first], reached, group = False, [first], [first]
            while reached and left.any():
                others = np.flatnonzero(left)
                found = others[(coded[others] == coded[reached.pop()]).sum(axis=1) >= least]
                left[found] = False
                reached += found.tolist()
                group += found.tolist()
            if len(group) > 1:
                members = np.sort(fps[group])
                key = int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64))
                out += [(key, fp) for fp in members.tolist()]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, fps, coded, long = None, [], [], False
        for batch in batches:
            out: list[tuple[int, int]] = []
            for t, fp, c in zip(batch["token"].tolist(), batch["fp"].tolist(), batch["coded"], strict=True):
                if t != token:
                    if len(fps) > 1 and not long:
                        out += groups(np.array(fps), np.frombuffer(b"".join(coded), dtype=np.uint8).reshape(-1, COORDINATES))
                    token, fps, coded, long = t, [], [], False
                if not long and len(fps) == run_rows:
                    out += [(t, f) for f in fps]
                    fps, coded, long = [], [], True
                if long:
                    out.append((t, fp))
                else:
                    fps.append(fp)
                    coded.append(c)
            yield pd.DataFrame(out, columns=["key", "fp"], dtype="int64")
        if len(fps) > 1 and not long:
            yield pd.DataFrame(groups(np.array(fps), np.frombuffer(b"".join(coded), dtype=np.uint8).reshape(-1, COORDINATES)), columns=["key", "fp"], dtype="int64")

    return run


def meeting(distinct: DataFrame, least: int = LEAST, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, fp): groups within which all pairs of at least `least` collisions are. distinct: (fp, signature), each set once."""
    signed = distinct.filter("signature IS NOT NULL").select("fp", "signature")
    tokens = map_batches(signed, _exploded, "fp long, token long")  # read twice: laid out anew, they take no disk
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = tokens.join(shared, "token").select("fp", "n", "token").repartition("fp")  # as rows: lists of one task's few tokens take more
    ranked = held.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))  # 64 tokens at most
    prefix = ranked.filter(F.size("held") >= least).select("fp", F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)["token"]).alias("token"))
    posts = stored(prefix, "posts")
    # Near copies share many lists; of those with the same members one is compared.
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).filter("n > 1")
    lists = stored(lists.groupBy("who", "n").agg(F.min("token").alias("token")).select("token"), "lists")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": batch["fp"], "coded": [_bytes_of(np.frombuffer(s, dtype=np.uint64)) for s in batch["signature"]]})

    # Whether a list is long depends on all of it, so a hot token's rows aren't salted: each has 80 bytes, and a task hands them on.
    meet = posts.join(lists, "token").join(map_batches(signed, coded, "fp long, coded binary"), "fp")
    return map_batches(meet.repartition("token").sortWithinPartitions("token", "fp").select("token", "fp", "coded"), collided(least, run_rows), "key long, fp long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS, run_items: int = RUN_ITEMS) -> DataFrame:
    """(id, n_shingles, fp, text_hash, class_fp, class_id) of each row: class_id is the least id reachable over links, fp names the set."""

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, SHINGLE) for t in batch["text"]]
            yield pd.DataFrame({"fp": batch["fp"], "n": np.array([len(x) for x in sets], dtype=np.int64), "shingles": [x.tobytes() for x in sets]})

    kind = id_type(docs, id_col)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    own = stored(map_batches(texts, _described, "id string, text_hash long, fp long, n long, signature binary").withColumn("id", F.col("id").cast(kind)), "signed-texts")
    one = F.min(F.struct(F.col("id").cast("string").alias("id"), "text_hash")).alias("one")
    distinct = stored(own.filter("n > 0").groupBy("fp").agg(F.min("id").alias("least"), one, F.any_value("n").alias("n"), F.any_value("signature").alias("signature")), "distinct-sets")
    members = stored(meeting(distinct, run_rows=run_rows).join(distinct.select("fp", F.col("n").alias("items")), "fp"), "candidates")
    wanted = stored(members.select("fp").distinct().join(distinct, "fp").select("fp", F.col("one.id").alias("_id"), F.col("one.text_hash").alias("_hash")), "met-sets")
    named = broadcast_if_small(wanted, 1_000_000)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    sets = map_batches(texts.join(named, same).select("fp", "text"), laid_out, "fp long, n long, shingles binary")
    if own.select(F.col("id").cast("string").alias("id"), "text_hash").join(named, same).count() > wanted.count():  # rows that repeat
        sets = sets.groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))
    slim = own.select("id", "n", "fp", "text_hash")
    found = classes(slim.filter("n > 0"), distinct.select("fp", "least"), links(members, sets, run_rows, run_items))
    alone = slim.filter("n = 0").withColumns({"class_fp": F.col("fp"), "class_id": F.col("id")})
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "fp", "text_hash", "class_fp", "class_id")
