"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three characters, words padded by a blank,
letters lower-cased, all else blank). A document's own list of most frequent n-grams is compared with each: the
distance sums how far each n-gram is out of place, an n-gram missing from the profile counting as the profile's
length. The nearest language is predicted, the first by name between equals; the score is 1 less the distance's
share of the largest possible.

Profiles are learned from all labelled documents given: tasks count n-grams by language, the counts are added up
after partial sums, and of each language the top n-grams remain. Up to `most_languages` of them are sent to all workers, at
most that many times `top` numbers. Beyond that, profiles stay a table, and the documents' lists are joined with it,
with the same result.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is any text where nothing was
learned; rows with a null label or text don't teach; rows that repeat count as often as they occur; empty tables
and extra columns are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import map_batches, ship, stored

TOP, UNKNOWN = 300, "und"
_CHARS = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text as numbers (three code points of 21 bits, blanks of shorter ones as 0), and their counts."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    letters, text = _letters(), text.lower()
    for i in range(0, len(text), _CHARS):
        # Windows overlap by a word's context: two characters before, so that no n-gram is lost or counted twice.
        code = np.frombuffer(text[max(0, i - 2) : i + _CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        is_letter = letters[code.astype(np.int64)]
        code = np.where(is_letter, code, 32).astype(np.uint64)
        if i == 0:
            code = np.concatenate((np.array([32], dtype=np.uint64), code))
            is_letter = np.concatenate(([False], is_letter))
        if i + _CHARS >= len(text):
            code = np.concatenate((code, np.array([32], dtype=np.uint64)))
            is_letter = np.concatenate((is_letter, [False]))
        fresh = 2 if i else 0
        one = code[fresh:][is_letter[fresh:]]
        two_from = 1 if i else 0
        a, b = code[two_from:-1], code[two_from + 1 :]
        la, lb = is_letter[two_from:-1], is_letter[two_from + 1 :]
        two = (a << np.uint64(21) | b)[la | lb]
        x, y, z = code[:-2], code[1:-1], code[2:]
        three = (x << np.uint64(42) | y << np.uint64(21) | z)[is_letter[1:-1]]
        found.append(np.unique(np.concatenate((one, two, three)), return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, between equals the smaller number."""
    if len(codes) > top:  # all that can be among the top, then sorted
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    """The profiles of all languages as one sorted table of n-grams with a column of ranks for each language."""

    def __init__(self, by_language: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(by_language), top
        self.codes = np.unique(np.array([c for v in by_language.values() for c in v], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(by_language[name], dtype=np.uint64)), k] = np.arange(len(by_language[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.top)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.ranks[at]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.top).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (self.top * len(own)))


@dataclass
class ProfileTable:
    """Profiles of more languages than workers should hold: a stored table (lang, gram, rank from 0), and the first language."""

    rows: DataFrame
    first: str
    top: int


def learn(docs: DataFrame, top: int = TOP, most_languages: int = 1000, text_col: str = "text", lang_col: str = "lang") -> Profiles | ProfileTable:
    """Profiles from all rows with a text and a label; most_languages bounds what the driver and each worker hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, (codes, counts) in sums.items():
                yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": counts})
            sums.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, held = [sums[lang]] if lang in sums else [], 0
                for t in texts:
                    parts.append(grams(t))
                    held += len(parts[-1][0])
                    if held > 500_000:
                        parts, held = [merged(parts)], 0
                sums[lang] = merged(parts)
            if sum(len(c) for c, _ in sums.values()) > 2_000_000:  # a bound for the task; what is flushed is summed later
                yield from flushed()
        yield from flushed()

    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = map_batches(labelled, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram")))
    found = stored(counts.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank")), "profiles")
    if found.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        return ProfileTable(found, found.agg(F.min("lang")).first()[0], top)
    by_language: dict[str, list[int]] = {}
    for r in found.orderBy("lang", "rank").collect():
        by_language.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_language, top)


def _found(rows: DataFrame, profiles: Profiles | ProfileTable) -> DataFrame:
    """rows (kept, text) as (kept, lang_pred, score)."""
    if isinstance(profiles, ProfileTable):
        return _joined(rows, profiles)
    shared = rows.sparkSession.sparkContext.broadcast(profiles)  # most_languages times top n-grams
    ship(rows.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return rows.select("kept", predicted("text").alias("found")).select("kept", "found.*")


def _joined(rows: DataFrame, profiles: ProfileTable) -> DataFrame:
    """As Profiles.predict, by a join of the documents' lists with the profiles: each n-gram in place saves `top`, less by how far it is out of place."""
    top = profiles.top

    @F.pandas_udf("array<long>")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([ranked(*grams(t or ""), top).view(np.int64) for t in texts])

    ship(rows.sparkSession)
    listed = stored(rows.select("kept", own("text").alias("own"), F.monotonically_increasing_id().alias("row")), "gram-lists")
    places = listed.select("row", F.posexplode("own").alias("place", "gram"))
    saved = F.lit(top) - F.abs(F.col("rank") - F.col("place"))
    near = places.join(profiles.rows, "gram").groupBy("row", "lang").agg(F.sum(saved).alias("saved"))
    best = near.groupBy(F.col("row").alias("_row")).agg(F.min(F.struct((-F.col("saved")).alias("less"), "lang")).alias("best"))
    size = F.size("own")
    # A document without any n-gram of the profiles is as far from all languages: the first by name.
    lang = F.when(size == 0, F.lit(UNKNOWN)).otherwise(F.coalesce(F.when(F.col("best.less") < 0, F.col("best.lang")), F.lit(profiles.first)))
    score = F.when(size == 0, F.lit(0.0)).otherwise(F.coalesce(-F.col("best.less"), F.lit(0)) / (size * F.lit(float(top))))
    return listed.join(best, F.col("row") == F.col("_row"), "left").select("kept", lang.alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, profiles: Profiles | ProfileTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    found = _found(docs.select(F.col(id_col).alias("kept"), F.col(text_col).alias("text")), profiles)
    return found.select(F.col("kept").alias(id_col), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, profiles: Profiles | ProfileTable, least_score: float, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The documents whose language is recognised with at least that score; rows and columns as they came.

    lang_col: a label, if there is one, which the language recognised mustn't contradict.
    """
    found = _found(docs.select(F.struct("*").alias("kept"), F.col(text_col).alias("text")), profiles)
    good = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if lang_col:
        good = good.filter(F.coalesce(F.col("kept").getField(lang_col), F.col("lang_pred")) == F.col("lang_pred"))
    return good.select("kept.*")
