import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()),
])


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    near = base[3].split()
    for i in range(30, 45):
        changed = list(near)
        changed[rng.randrange(len(changed))] = word()
        rows.append((i, " ".join(changed), "en", "s0", None))
    rows += [(i, base[5], "en", "s0", 1) for i in range(45, 65)]
    rows += [(65, None, None, None, None), (66, "", "fr", None, 0), (67, " \n\t ", "fr", "s1", 4), (68, "%%% 123 …", "fr", "s2", 9), (69, "one two", "en", "😀", 7)]
    rows += [(70, " ".join(word() for _ in range(60_000)), "en", "s1", None)]
    rows += [(71, base[7], "de", "s2", 5)] * 2 + [(None, base[8], "de", "s2", 5), (None, "neither id nor twin here", None, "s1", 1), (2**60 + 1, "É ß ﬁ 漢字 😀 <|endoftext|> x", "fr", "s9", 3)]
    return [(*r, "f", "z", "k") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
