import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.minhash import BINS, PROBES, fingerprint, fingerprint_edits, likeness, probe_orders, shingle_hashes, signature, with_next


def neighbours(rows):
    """(id, text, following text) by descending id, nulls last, equal ids by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def jaccard(a, b):
    def s(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edits_and_likeness(odd):
    found = fingerprint_edits(odd)
    want = neighbours([(r["doc_id"], r["text"]) for r in odd.collect()])
    edited = sorted((i is None, i or 0, len(t), t[: len(t) - len(t) // 3] + n[: len(t) // 3]) for i, t, n in want)
    rows = found.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_text"]) for r in rows) == edited
    texts = {i: (t, n) for i, t, n in want if i not in (None, 71)}
    for r in rows:
        if r["doc_id"] in texts:
            t, n = texts[r["doc_id"]]
            assert abs(r["near_edited"] - jaccard(t, t[: len(t) - len(t) // 3] + n[: len(t) // 3])) < 0.2
            assert abs(r["near_next"] - jaccard(t, n)) < 0.2
    by_text = {}
    for r in odd.select("text", fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect():
        assert by_text.setdefault(r["text"] or "", r["f"]) == r["f"] and len(r["f"]) == 2 * BINS


def test_many_ranges(spark):
    from tidemark.llm.minhash import with_next

    rng = random.Random(1)
    rows = [(rng.randrange(300), f"t{i}") for i in range(500)] + [(None, "n1"), (None, "n2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (7, 100, 5000):
        dealt, window = with_next(docs, {"text": F.col("text")}, "doc_id", bucket_rows=n)
        got = dealt.withColumn("next", F.lead("text").over(window)).filter("not guard").collect()
        assert sorted((r["text"], r["next"]) for r in got) == sorted((t, n) for _, t, n in neighbours(rows))


def test_empty_and_single(spark, none):
    assert fingerprint_edits(none).count() == 0
    one = fingerprint_edits(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_text"] == "a b c da b c"[:11] or one["n_chars"] == 11


def test_signature_is_one_permutation_with_optimal_densification(spark):
    texts = ["a b c d e f g", " ".join(f"w{i}" for i in range(90)), " ".join(f"w{i}" for i in range(3000)), "x", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = docs.select("text", shingle_hashes(F.col("text")).alias("h"), signature(shingle_hashes(F.col("text"))).alias("s")).collect()
    order, half = probe_orders(BINS, PROBES, 5), BINS // 2
    bins = [*range(half, BINS), *range(half)]
    for r in rows:
        if not r["h"]:
            assert r["s"] is None
            continue
        least = {}
        for h in r["h"]:
            b = (h & (1 << 64) - 1) >> 57
            least[b] = min(least.get(b, h), h)
        for b, got in zip(bins, r["s"], strict=True):
            lender = next((x for x in [b, *order[b]] if x in least), None)
            assert got == least[lender] if lender is not None else got in least.values()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_estimate_is_unbiased(spark, share):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        common = [f"c{i}-{j}" for j in range(int(400 * share))]
        own = lambda k: [f"{k}{i}-{rng.random()}" for _ in range(int(200 * (1 - share)))]
        rows.append((" ".join(common + own("a")), " ".join(common + own("b"))))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("l"))
    got = df.collect()
    mean = sum(r["l"] - jaccard(r["a"], r["b"]) for r in got) / len(got)
    assert abs(mean) < 0.03


def test_string_ids(spark):
    rows = [(f"k{i:05}", f"text number {i} of some words") for i in range(500)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    dealt, window = with_next(docs, {"text": F.col("text")}, "doc_id", bucket_rows=50)
    got = {r["id"]: r["following"] for r in dealt.withColumn("following", F.lead("text").over(window)).filter("not guard").collect()}
    down = sorted((i, t) for i, t in rows if i)[::-1] + [rows[-1]]
    assert got == {i: down[(k + 1) % len(down)][1] for k, (i, _) in enumerate(down)}


def plain_next(rows, many):
    """Counts of (id, text, next text): by descending id, nulls last, equal ids by text, those with `many` rows or more by the text's digest."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    counts = Counter(i for i, _ in rows)
    tie = lambda i, t: (signed(xxhash.xxh64_intdigest(t.encode(), 42)) if counts[i] >= many else 0, t.encode())
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], tie(*r)))
    return Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


@pytest.mark.parametrize("case", ["null", "least", "greatest", "all", "several"])
def test_crowded_ids(spark, case):
    """A third of the rows and more under one id, or none, half of them the same row: parts stay small, and no row is lost."""
    rng = random.Random(3)
    rows = [(rng.randrange(100, 400), f"t{i}") for i in range(400)]
    crowds = {"null": [None], "least": [5], "greatest": [900], "all": [None, 5, 200, 900], "several": [200, 201, 250]}[case]
    for x in crowds:
        rows += [(x, f"own {i}") for i in range(150)] + [(x, "same")] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (10, 40):
        dealt, window = with_next(docs, {"text": F.col("text")}, "doc_id", bucket_rows=n)
        placed = dealt.withColumn("next", F.lead("text").over(window)).filter("not guard").collect()
        assert Counter((r["id"], r["text"], r["next"]) for r in placed) == plain_next(rows, 3 * max(n, -(-len(rows) // -(-len(rows) // n))))
        sizes = Counter((r["bucket"], r["sub"], r["copy"]) for r in placed)
        assert max(sizes.values()) <= 5 * n


def test_only_one_id(spark):
    for x in (None, 7):
        rows = [(x, "a"), (x, "b")] * 30
        dealt, window = with_next(spark.createDataFrame(rows, "doc_id long, text string"), {"text": F.col("text")}, "doc_id", bucket_rows=5)
        got = Counter((r["id"], r["text"], r["next"]) for r in dealt.withColumn("next", F.lead("text").over(window)).filter("not guard").collect())
        assert got == plain_next(rows, 15)


def test_edits_of_crowded_ids(spark, monkeypatch):
    """Whole results where rows without an id crowd, against the texts that follow."""
    monkeypatch.setattr(minhash, "CROWDED", 0)
    rows = [(i, f"text {i} " + "word " * i) for i in range(40)] + [(None, f"no id {i % 9} of several") for i in range(60)]
    got = Counter((r["doc_id"], r["n_chars"], r["edited_text"]) for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for (i, t, n), k in plain_next(rows, 41).items():
        want[i, len(t), t[: len(t) - len(t) // 3] + n[: len(t) // 3]] += k
    assert got == want
