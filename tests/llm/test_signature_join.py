import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_copies import edited
from tidemark.llm.queries import QUERIES
from tidemark.llm.signature_join import COORDINATES, LEAST, collided, near_duplicates, signature


def plain_set(text):
    words = [w for w in (text or "").translate({**{c: " " for c in range(9, 14)}, **{c: chr(c + 32) for c in range(65, 91)}}).split(" ") if w]
    return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def plain_rows(rows):
    """(id, n_shingles, least id reachable) over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in holders[g]:
                both[j] += 1
        for j, n in both.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), len(s), str(least.get(r))) for r, s, (i, _) in zip(root, sets, rows, strict=True))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["class_id"])) for r in df.collect())


@pytest.fixture(scope="module")
def family():
    """Many near copies of one text (not all near one another), strangers that share most of it, unrelated texts, short ones."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    base = fresh(120)
    texts = [edited(rng, base, rng.choice((1, 3, 6, 9, 12))) for _ in range(150)]
    texts += [" ".join(base[:60] + fresh(60)) for _ in range(80)]
    texts += [" ".join(fresh(rng.randint(1, 200))) for _ in range(50)]
    for edits in range(1, 12):
        own = fresh(110)
        texts += [" ".join(own), edited(rng, own, edits)]
    texts += ["", " \n", None, "a", "A", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f", "b c d e f", "one", "a b c d e"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("run_rows", "run_items"), [(2048, 4_000_000), (20, 3000), (3, 900)])
def test_classes_against_all_pairs(spark, family, run_rows, run_items):
    """Within the bounds of a task, and with runs that must be split."""
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(5)
    assert found(near_duplicates(docs, run_rows=run_rows, run_items=run_items)) == plain_rows(family)


def test_odd_rows(odd, none):
    assert found(near_duplicates(odd)) == plain_rows([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert near_duplicates(none).count() == 0


def test_ids_of_other_kinds(spark):
    docs = spark.createDataFrame([("b", "a b c"), ("a", "A B C"), (None, "a b c"), (None, "x y"), ("c", None)], "doc_id string, text string")
    assert sorted((str(r[0]), str(r["class_id"])) for r in near_duplicates(docs).collect()) == [("None", "None"), ("None", "a"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_collisions_estimate_likeness():
    """Coordinates collide as often as sets are alike, so the threshold keeps pairs of the least likeness."""
    import numpy as np

    rng, counts = np.random.default_rng(1), []
    for _ in range(300):
        shared, own = rng.integers(0, 1 << 63, 160, dtype=np.uint64), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        counts.append(int((signature(np.concatenate((shared, own[:20]))) == signature(np.concatenate((shared, own[20:])))).sum()))
    assert abs(np.mean(counts) - 0.8 * COORDINATES) < 1 and min(counts) > LEAST + 3


def test_long_lists_are_handed_on_whole():
    import pandas as pd

    rows = pd.DataFrame({"token": [1] * 7 + [2] * 2, "fp": list(range(7)) + [3, 9], "coded": [bytes(64)] * 9})
    got = pd.concat(collided(LEAST, 3)(iter([rows.iloc[:5], rows.iloc[5:]])))
    assert sorted(got[got["key"] == 1]["fp"]) == list(range(7))
    assert sorted(got[got["key"] != 1]["fp"]) == [3, 9]


def test_query_s_columns(spark, sf):
    rows = QUERIES["op12_signature_join"](spark, sf)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
