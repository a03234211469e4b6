"""Spelling variants: words that differ by one letter, each with the most frequent of its near words as its form.

Of two words one error apart, either the first half is the same or the second one. So each word is looked up twice: in an
automaton of words with its first half exact and the rest with one error, and in an automaton of reversed words with its last half exact.
Both automata are minimal and number their words. A pair that agrees in both halves is taken from the forward one alone.

Half of what? Of the shorter word of a pair, whose length is a word's own or one less, so that both words name the same half.
These halves, at most two a word and direction, deal the words to tasks; a task reads whole groups, sorted, and builds
automata over lots of at most `lot_words` words. A group beyond that would not fit a lot: its words are matched by what is left
of them without one letter, which gives the same pairs by joins whose groups are as small as the alphabet.

What comes out is summed by word, never as a table of pairs. Chains of forms are followed by doubling.

Defined cases: null texts have no words; a null id counts as an empty one in the digest of a run; of a run that is one long
word all is kept; rows that repeat count again; an empty table gives no words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_if_small, map_batches, stored
from tidemark.llm.automaton import Automaton

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many runs loses a letter.
MISSPELLED = 199
LEAST_LETTERS, LEAST_COUNT, FREQUENT = 6, 5, 5
LOT_WORDS = 20_000


def without(word: Column, at: Column) -> Column:
    """word without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, misspelled: int = MISSPELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, with the misspellings that a digest of id and run decides."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit("([a-zÀ-ÿ]+)"), F.lit(1))
    # A run never gets longer, so shorter ones leave before they are hashed.
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).filter(F.char_length("run") >= least_letters)
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    word = F.when(F.col("h") % misspelled == 0, without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def halves(least_letters: int) -> Column:
    """The groups of a word: (side, half) for pairs whose shorter word has its own length, or one less."""
    length = F.char_length("word")

    def of(shorter: Column) -> list[Column]:
        first = F.floor(shorter / 2).cast("int")
        ends = ((False, F.col("word"), first), (True, F.reverse("word"), (shorter - first).cast("int")))
        return [F.struct(F.lit(back).alias("back"), F.substring(text, F.lit(1), n).alias("half")) for back, text, n in ends]

    own, less = of(length), of(length - 1)
    return F.array_distinct(F.concat(F.array(*own), F.when(length > least_letters, F.array(*less)).otherwise(F.array().cast("array<struct<back:boolean,half:string>>"))))


def here(word: str, other: str, back: bool, half: int) -> bool:
    """Whether the pair belongs to the group of that half; each pair does to one group alone."""
    shorter = min(len(word), len(other))
    first = shorter // 2
    return half == (shorter - first if back else first) and not (back and word[:first] == other[:first])


def look_up(lot: list[tuple[str, str, int]], back: bool) -> list[tuple[str, int, int, str]]:
    """(word, near words, n and text of the first of them) for each (half, word, n) of whole groups; halves and automaton of reversed words if back."""
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    counts = {turn(word): n for _, word, n in lot}
    ordered = sorted(counts)
    automaton, out = Automaton(ordered), []
    for half, word, _ in lot:
        turned = turn(word)
        near = [(-counts[ordered[k]], other) for k in automaton.with_one_error(half, turned[len(half) :]) if here(word, other := turn(ordered[k]), back, len(half))]
        if near:
            n, first = min(near)
            out.append((word, len(near), -n, first))
    return out


def lots(lot_words: int):
    """mapInPandas function over rows (back, half, word, n) sorted by group: whole groups are put together to lots of at most lot_words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot, group, key, out = [], [], None, []

        def close(back: bool | None) -> None:
            """The group is whole: add it to the lot, after looking up the lot where they'd be too many, or the direction turns."""
            nonlocal lot, group
            if lot and len(lot) + len(group) > lot_words:
                out.extend(look_up(lot, key[0]))
                lot = []
            lot, group = lot + group, []
            if lot and back != key[0]:
                out.extend(look_up(lot, key[0]))
                lot = []

        for batch in batches:
            for back, half, word, n in zip(batch["back"].tolist(), batch["half"].tolist(), batch["word"].tolist(), batch["n"].tolist(), strict=True):
                if (back, half) != key:
                    if key is not None:
                        close(back)
                    key = (back, half)
                group.append((half, word, n))
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
            out.clear()
        if key is not None:
            close(None)
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    return run


def _crowded(rows: DataFrame) -> DataFrame:
    """What `lots` gives, for groups of any size, by joins on words without a letter. rows: (back, half, word, n)."""
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("at")).withColumn("left", without(F.col("word"), F.col("at")))
    other = [F.col(c).alias(f"o_{c}") for c in ("word", "n")]
    replaced = cut.join(cut.select("back", "half", "at", "left", *other), ["back", "half", "at", "left"]).filter("word != o_word")
    longer = cut.dropDuplicates(["back", "half", "word", "left"]).join(rows.select("back", "half", F.col("word").alias("left"), *other), ["back", "half", "left"])
    pairs = replaced.select("back", "half", "word", "n", "o_word", "o_n").union(longer.select("back", "half", "word", "n", "o_word", "o_n"))
    pairs = pairs.union(longer.select("back", "half", "o_word", "o_n", "word", "n"))
    shorter = F.least(F.char_length("word"), F.char_length("o_word"))
    first = F.floor(shorter / 2).cast("int")
    both = F.substring("word", F.lit(1), first) == F.substring("o_word", F.lit(1), first)
    mine = (F.char_length("half") == F.when(F.col("back"), shorter - first).otherwise(first)) & ~(F.col("back") & both)
    best = F.min(F.struct((-F.col("o_n")).alias("m"), "o_word"))
    return pairs.filter(mine).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.o_word").alias("best"))


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, lot_words: int = LOT_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of each word that has near words: how many, and the most frequent, the first of these. words: (word, n), stored."""
    dealt = words.select("word", "n", F.explode(halves(least_letters)).alias("group")).select("group.back", "group.half", "word", "n")
    sizes = stored(dealt.groupBy("back", "half").agg(F.count(F.lit(1)).alias("of")).filter("of > 1"), "word-groups")
    crowded = sizes.filter(F.col("of") > lot_words)
    fits = dealt.join(broadcast_if_small(sizes.filter(F.col("of") <= lot_words).select("back", "half"), 1_000_000), ["back", "half"])
    laid = fits.repartition("back", "half").sortWithinPartitions("back", "half", "word").select("back", "half", "word", "n")
    found = map_batches(laid, lots(lot_words), "word string, n_near long, best_n long, best string")
    if crowded.limit(1).count():
        found = found.union(_crowded(stored(dealt.join(broadcast_if_small(crowded.select("back", "half"), 100_000), ["back", "half"]), "crowded-groups")))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form). A form is far more frequent than its word, so chains end within some 30 steps."""
    chain = stored(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = chain.select(F.col("word").alias("via"), F.col("root").alias("further"))
        chain = stored(chain.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if chain.filter("moved").limit(1).count() == 0:
            return chain.select("word", "root")


def variants(words: DataFrame, frequent: int = FREQUENT, least_letters: int = LEAST_LETTERS, lot_words: int = LOT_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the form is the most frequent near word, if at least `frequent` times as frequent."""
    words = stored(words.select("word", "n"), "words")
    near = near_words(words, least_letters, lot_words)
    formed = F.col("best_n") >= frequent * F.col("n")
    rows = stored(words.join(near, "word", "left").select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")), "word-forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
