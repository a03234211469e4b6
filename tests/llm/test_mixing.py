import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, mix_plan


def plain_targets(sizes: dict, max_rate=3.0) -> dict:
    """The contract as it is told: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    free = set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        over = 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= max_rate * sizes[s]:
                over += target[s] - max_rate * sizes[s]
                target[s] = max_rate * sizes[s]
                free.discard(s)
        left = over
    return target


def check(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    rate = {s: min(3.0, targets[s] / sizes[s]) if sizes[s] else 0.0 for s in sizes}
    hexes = lambda *parts: hashlib.md5(":".join(["23", *parts]).encode()).hexdigest()
    digest = {(i, t): hexes("" if i is None else str(i), t or "") for i, t, _ in rows}
    strata = defaultdict(list)
    for i, t, s in rows:
        b = f"{size(t):b}"
        strata[s, f"{len(b):02}{b[:4]}"].append((digest[i, t], i, t))
    last, upto = {}, Counter()
    for s, b in sorted(strata, key=lambda k: k[1]):
        f, u = rate[s] - int(rate[s]), int(hexes("none" if s is None else f"source {s}")[:12], 16) / 2**48
        n = len(strata[s, b])
        wanted = math.floor(f * (upto[s] + n) + u) - math.floor(f * upto[s] + u)
        upto[s] += n
        last[s, b] = sorted(strata[s, b])[wanted - 1][0] if wanted else ""
    want = Counter()
    for (s, b), members in strata.items():
        for d, i, t in members:
            r = rate[s]
            want[(i, size(t), sizes[s], round(targets[s], 6), int(r) + (d <= last[s, b]))] += 1
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mix_plan(docs).collect())
    assert got == want
    return rows, got


def test_against_brute_force(odd, none):
    rows, got = check(odd)
    assert check(none)[1] == Counter()
    assert all(c <= 3 for *_, c in got)


def test_excess_is_shared_again(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 1), ("c", 2), ("d", 300), ("e", 0), (None, 5)] * 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_totals_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"target": "max", "source_size": "max"})
    taken = mix_plan(docs).selectExpr("doc_id", "size", "size * copies as words").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"words": "sum", "size": "max"})
    for r in plan.join(taken, "source").collect():  # one rounding, of a document no larger than the largest, and sizes within a stratum
        assert abs(r["sum(words)"] - r["max(target)"]) < r["max(size)"] + 0.02 * r["max(target)"]


def test_mix_repeats_rows(odd):
    copies = defaultdict(int)
    for r in mix_plan(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_probability_is_the_fraction_whatever_the_size(spark):
    """Over many sources alike, a large and a small document get their extra copy equally often."""
    sizes, sources = [1000, 10, 11, 12, 12], 400
    rows = [(5 * s + k, f"d{s} " * n, f"s{s:04}") for s in range(sources) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix_plan(docs, weight=lambda rank: F.when(rank % 2 == 0, 3).otherwise(7)).collect()
    extra, seen = Counter(), Counter()
    for r in plan:
        f = round(r["rate"] - int(r["rate"]), 6)
        extra[f, r["doc_id"] % 5] += r["copies"] - int(r["rate"])
        seen[f, r["doc_id"] % 5] += 1
    assert {f for f, _ in seen} == {0.6, 0.4} and len(seen) == 10
    for (f, k), n in seen.items():
        assert abs(extra[f, k] / n - f) < 3.5 * math.sqrt(f * (1 - f) / n), (f, k, extra[f, k] / n)


@pytest.mark.parametrize("sources", [1, 2, 6, 400])
def test_sources_of_equal_ratio(spark, sources):
    """Where several sources have the same size for their weight, or the same size at all, the targets still share everything."""
    docs = spark.createDataFrame([(i, "w " * 20, f"s{i:04}") for i in range(sources)], "doc_id long, text string, source string")
    targets = [r["target"] for r in mix_plan(docs).select("target", "doc_id").join(docs, "doc_id").orderBy("source").collect()]
    weights = [i % 3 + 1 for i in range(sources)]
    assert sum(targets) == pytest.approx(20 * sources)
    assert targets == pytest.approx([20 * sources * w / sum(weights) for w in weights])
