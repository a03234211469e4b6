import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm.automaton import Automaton
from tidemark.llm.spelling import here, near_words, variants, word_counts


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def plain_variants(counts):
    rows = {}
    for w, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        rows[w] = (best if best and counts[best] >= 5 * n else None, n, len(others))
    out = []
    for w, (form, n, many) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, many, counts[form] if form else None))
    return sorted(out, key=repr)


def vocabulary(rng, many, letters="abé"):
    """Words of few letters, so that many are near, of all lengths."""
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(many)}
    long = "".join(rng.choice("xyz") for _ in range(40))
    found |= {long, long[:20] + "q" + long[20:], long[:19] + long[20:], long[:-1], long[1:], "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿÿÿÿÿÿ", "zzzzzzÿ"}
    return {w: rng.choice((5, 6, 30, 150, 1000, 5000)) for w in sorted(found)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("lot_words", [20_000, 40, 3])
def test_against_all_pairs(spark, lot_words):
    """In one lot, in many, and with groups that don't fit one."""
    counts = vocabulary(random.Random(1), 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(variants(words, lot_words=lot_words)) == plain_variants(counts)


def test_texts_of_odd_rows(spark, odd, none):
    assert {r["word"]: r["n"] for r in word_counts(odd, least_count=1).collect()} == plain_counts([(r["doc_id"], r["text"]) for r in odd.collect()], 1)
    assert variants(word_counts(none)).count() == 0
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(("Straße", "STRAßE", "señorita", "señoritas", "l'Élève", "élève×÷", "çaÿÿÿÿ", "naïveté2naïvete", "abcdef", "abcdeg", "x" * 9)) for _ in range(60))) for i in range(300)]
    texts += [(None, "abcdef " * 300), (7, None), (8, ""), (9, "12 ŒŒŒŒŒŒŒ 😀"), (9, "abcdeg")] + [(5, "ABCDEF")] * 7
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, word int, n string")
    counts = plain_counts(texts)
    assert len(counts) >= 15 and rows_of(variants(word_counts(docs))) == plain_variants(counts)


def test_chains(spark):
    counts = {"aaaaaa" + "b" * k: 6**k for k in range(1, 12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants(words)) == plain_variants(counts)
    assert {r["root"] for r in variants(words).collect()} == {"aaaaaa" + "b" * 11}


def test_a_pair_is_in_one_group():
    rng = random.Random(4)
    words = sorted(vocabulary(rng, 120, "ab"))
    for a in words:
        for b in words:
            if near(a, b):
                found = [(back, k) for back in (False, True) for k in range(3, 25) if here(a, b, back, k) and (a[::-1][:k] == b[::-1][:k] if back else a[:k] == b[:k])]
                assert len(found) == 1


def test_automata_number_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(300)})
    automaton = Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words))) and automaton.number("abcabcabc") is None
    assert len(automaton.steps) < len({w[:k] for w in words for k in range(len(w) + 1)})
    for w in words:
        for k in range(len(w) + 1):
            want = sorted(i for i, o in enumerate(words) if o.startswith(w[:k]) and near(w[k:], o[k:]))
            assert sorted(automaton.with_one_error(w[:k], w[k:])) == want
    assert Automaton([]).number("") is None


def test_near_words_count_each_pair_once(spark):
    words = spark.createDataFrame([("abcdef", 9), ("abcdeg", 8), ("bbcdef", 7), ("abcdeff", 5), ("zbcdef", 9)], "word string, n long")
    assert rows_of(near_words(words)) == [("abcdef", 4, 9, "zbcdef"), ("abcdeff", 1, 9, "abcdef"), ("abcdeg", 1, 9, "abcdef"), ("bbcdef", 2, 9, "abcdef"), ("zbcdef", 2, 9, "abcdef")]
