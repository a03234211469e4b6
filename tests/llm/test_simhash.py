import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import keep_one, links, near_duplicates, text_fingerprint


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({**{c: " " for c in range(9, 14)}, **{c: chr(c + 32) for c in range(65, 91)}}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, radius=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {f: top(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    for t in (None, "", " \x0b ", "Ab cD", "a b c d", "É É é x y z A B C " * 50, "no break space a b c d e f"):
        assert text_fingerprint(t) == plain_fingerprint(t)


def test_classes_against_brute_force(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    classes = plain_classes([plain_fingerprint(t) for _, t in rows])
    least = defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[classes[plain_fingerprint(t)]].append(i)
    name = {c: min(v) for c, v in least.items()}
    want = sorted((str(i), signed(plain_fingerprint(t)), str(name.get(classes[plain_fingerprint(t)]))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fp"], str(r["class_id"])) for r in near_duplicates(odd).collect()) == want
    assert near_duplicates(none).count() == 0


def test_the_data_s_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    classes = plain_classes([f for _, f in rows])
    name = {}
    for i, f in sorted(rows):
        name.setdefault(classes[f], i)
    assert {(r["doc_id"], r["class_id"]) for r in near_duplicates(docs).collect()} == {(i, name[classes[f]]) for i, f in rows}


@pytest.mark.parametrize("run_rows", [2048, 3, 1])
def test_no_link_is_lost_in_crowds(spark, run_rows):
    """Dense clouds around few centres, chains, and far points; long runs go through whole balls."""
    rng = random.Random(run_rows)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):  # a chain of steps of exactly four bits
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    want = plain_classes(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links(df, run_rows=run_rows)).collect()}
    groups = lambda m: {frozenset(f for f in fps if m(f) == c) for c in {m(f) for f in fps}}
    assert groups(lambda f: root.get(f, f)) == groups(want.get)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}
    assert components(df.limit(0)).count() == 0


def test_keep_one(odd, spark, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    classes = plain_classes([plain_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            c = classes[plain_fingerprint(t)]
            least[c] = min(i, least.get(c, i))
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, least.values()), "None", "None"])
    assert keep_one(none).count() == 0
    same_id = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z other words"), (2, "v w x y z other words"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(r["text"] for r in keep_one(same_id).collect()) == ["a b c d e", "v w x y z other words"]


def test_columns_of_any_name_are_kept(odd):
    names = ["_gone", "_hash", "id", "text_hash", "head_id", "head", "row", "row_id", "class_id", "c", "n"]
    more = odd.select("doc_id", "text", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    kept = keep_one(more)
    assert kept.columns == more.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in kept.collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in keep_one(odd).collect())
