import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import pytest

from tidemark.llm.linking import link_run
from tidemark.llm.near_copies import near_copies, shingle_set


def plain_set(text):
    words = [w for w in (text or "").translate({**{c: " " for c in range(9, 14)}, **{c: chr(c + 32) for c in range(65, 91)}}).split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(texts):
    """Least index of each text's class, over all pairs of Jaccard 0.8 or more."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies on both sides of 0.8, a star whose points are only near its centre, a chain, and a common passage."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    found = []
    for edits in range(1, 13):
        base = fresh(300)
        found += [" ".join(base), edited(rng, base, edits)]
    base = fresh(400)
    star = [edited(rng, base, 8) for _ in range(40)] + [" ".join(base)]
    chain = [fresh(200)]
    for _ in range(8):
        chain.append(edited(rng, chain[-1], 3).split())
    passage = " ".join(fresh(100))
    found += star + [" ".join(c) for c in chain] + [passage + " " + " ".join(fresh(100)) for _ in range(60)]
    return found + ["", " ", "one two", "One  two", "one two three four five", "one two three four six"]


def test_stage_against_brute_force_jaccard(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_classes(texts)))
    assert kept.columns == docs.columns


def test_runs_are_verified_whole(texts):
    """All texts in one run, in any order."""
    order = random.Random(1).sample(range(len(texts)), len(texts))
    sets = {i: shingle_set(texts[i]) for i in order}
    links, want = link_run(order, [sets[i] for i in order]), plain_classes(texts)
    groups = defaultdict(set)
    for i in order:
        groups[dict(links).get(i, i)].add(i)
    whole = defaultdict(set)
    for i in order:
        whole[want[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, whole.values()))


@pytest.mark.parametrize(("run_rows", "run_items"), [(5, 4_000_000), (2048, 2500)])
def test_runs_beyond_a_task_are_split(spark, texts, run_rows, run_items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_copies(docs, run_rows=run_rows, run_items=run_items)
    assert [r["class_id"] for r in got.orderBy("doc_id").collect()] == plain_classes(texts)


def test_classes_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    classes, least = plain_classes([t for _, t in rows]), {}
    for c, (i, _) in zip(classes, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((str(i), str(least.get(c))) for c, (i, _) in zip(classes, rows, strict=True))
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_copies(odd).collect()) == want
    assert near_copies(none).count() == 0


def plain_simhash(text):
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in plain_set(text)]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("run_rows", [2048, 3])
def test_simhash_brings_texts_together(spark, texts, run_rows):
    """Without bands, the links are those of op7's method alone: SimHashes within 4 bits, likeness of 0.8 or more."""
    sets, sims, root = [plain_set(t) for t in texts], [plain_simhash(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and (sims[i] ^ sims[j]).bit_count() <= 4]
    reached = list(range(len(texts)))
    for i, j in near:
        a, b = sorted((reached[i], reached[j]))
        reached = [a if r == b else r for r in reached]
    # What hangs together by bits is checked as a whole.
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or reached[i] == reached[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [r["class_id"] for r in near_copies(docs, run_rows=run_rows, bands=0).orderBy("doc_id").collect()]
    assert got == root
    assert sum(c != i and sets[i] != sets[c] for i, c in enumerate(got)) > 3


def test_runs_that_share_texts_are_united(spark):
    """A text is sent once where what hangs together is within the bounds; beyond them runs stay as they were."""
    from tidemark.llm.linking import united

    rows = [(1, 10, 5), (1, 11, 5), (2, 11, 5), (2, 12, 5), (3, 10, 5), (3, 12, 5), (4, 20, 5), (4, 21, 5)] + [(k, 30 + k + d, 5) for k in range(5, 10) for d in (0, 1)]
    sized = spark.createDataFrame(rows, "key long, fp long, items long")
    groups = defaultdict(list)
    for r in united(sized, 4, 100).collect():
        groups[r["key"]].append(r["fp"])
    assert sorted(map(sorted, groups.values())) == [[10, 11, 12], [20, 21], *([30 + k, 31 + k] for k in range(5, 10))]
