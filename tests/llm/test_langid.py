from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.langid import Profiles, accepted, grams, held_out, identify, learn


def plain_grams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = Counter()
    for i, c in enumerate(s):
        if c != " ":
            out[(c,)] += 1
        if i + 1 < len(s) and s[i : i + 2] != "  ":
            out[tuple(s[i : i + 2])] += 1
        if i + 2 < len(s) and s[i + 1] != " ":
            out[tuple(s[i : i + 3])] += 1
    return out


def decoded(text):
    codes, counts = grams(text)
    return Counter({tuple(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)})


def test_grams_against_brute_force(monkeypatch):
    texts = ["", "a", "Ab, cd!  éÉ", "漢字 😀 x", "İstanbul " * 9, "one two three " * 40]
    for size in (1 << 18, 7, 3):
        monkeypatch.setattr(langid, "_CHARS", size)
        for t in texts:
            assert decoded(t) == plain_grams(t), (size, t)


def test_prediction_against_brute_force():
    samples = {"x": "the cat and the dog and the hat", "y": "der hund und die katze und der hut", "z": "le chat et le chien et le chapeau"}
    top = 40
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda kv: (-kv[1], sum(ord(ch) << 21 * (len(kv[0]) - 1 - i) for i, ch in enumerate(kv[0]))))][:top]
    number = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - i) for i, ch in enumerate(g))
    plain = {k: order(plain_grams(v)) for k, v in samples.items()}
    profiles = Profiles({k: [number(g) for g in v] for k, v in plain.items()}, top)
    for t in ("the dog", "und die hut katze", "chien le", "zzz qqq", "the und le"):
        own = order(plain_grams(t))
        distance = {k: sum(abs(i - v.index(g)) if g in v else top for i, g in enumerate(own)) for k, v in plain.items()}
        best = min(sorted(distance), key=distance.get)
        assert profiles.predict(t) == (best, 1 - distance[best] / (top * len(own)))
    for t in (None, "", "123 %%"):
        assert profiles.predict(t) == ("und", 0.0)
    assert Profiles({}).predict("text") == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = held_out(F.col("doc_id"))
    found = identify(docs, learn(docs.filter(~held))).join(docs.filter(held & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_rows(odd, none):
    profiles = learn(odd)
    assert profiles.names == ["de", "en", "fr"]
    rows = identify(odd, profiles).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (65, 66, 67, 68)} == dict.fromkeys((65, 66, 67, 68), "und")
    kept = accepted(odd, profiles, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert learn(none).names == [] and identify(none, profiles).count() == 0


def test_profiles_that_stay_a_table_predict_alike(odd, none):
    few, many = learn(odd), learn(odd, most_languages=2)
    assert isinstance(many, langid.ProfileTable)
    rows = odd.withColumn("lang_pred", F.lit(1)).withColumn("kept", F.lit(2)).dropDuplicates(["doc_id"])
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 12)) for r in identify(rows, p).collect()} for p in (few, many))
    assert a == b and len({x for x, _ in a.values()}) >= 3
    assert sorted(map(str, accepted(rows, few, 0.2).collect())) == sorted(map(str, accepted(rows, many, 0.2).collect()))
    assert identify(none, many).count() == 0


def test_letters_of_all_planes():
    last = chr(0x30000)
    assert last.isalpha() and decoded(last) == plain_grams(last)
    assert Profiles({"x": [0x30000], "y": [97]}, 5).predict(last)[0] == "x"


def test_labels_that_contradict(spark):
    texts = {"en": "the cat and the dog and the hat", "de": "der hund und die katze und der hut"}
    docs = spark.createDataFrame([(i, texts[t], t if i < 8 else other) for i, (t, other) in enumerate([("en", "de"), ("de", "en")] * 5)], "doc_id long, text string, lang string")
    profiles = learn(docs.filter("doc_id < 8"))
    assert sorted(r["doc_id"] for r in accepted(docs, profiles, 0.0, lang_col="lang").collect()) == list(range(8))
    assert accepted(docs.withColumn("lang", F.lit(None).cast("string")), profiles, 0.0, lang_col="lang").count() == 10
