import json
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm.conftest import DOCS, odd_rows
from tests.llm.test_near_copies import plain_classes
from tidemark.llm import langid, mixing


#: Consonants in no language, and a text whose label may contradict it.
NOISE = " ".join("".join("bcdfghjklmnpqrstvwxz"[(7 * i * i + 3 * k * i + k) % 20] for k in range(7)) for i in range(200))
SPANISH = "que de la osdo ciónes en los para ciónque una del estaue todo con jaado ñboar que de los las ciónado amente"


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "123 456", "en", "src1", 7), (10_002, NOISE, "en", "src1", 7), (10_003, SPANISH, "fr", "src1", 7), (10_004, SPANISH, None, "src1", 7)], docs.schema)
    docs = docs.unionByName(extra)
    columns, kept = docs.columns, None
    profiles = langid.learn(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i == 0:
            found = {r["doc_id"]: (*profiles.predict(r["text"]), r["lang"]) for r in before.collect()}
            want = {i for i, (lang, score, label) in found.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE and label in (lang, None)}
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept == want and not kept & {10_000, 10_001, 10_002, 10_003} and 10_004 in kept
            assert len(found) - len(kept) < 4 + 0.01 * len(found)
        if i == 1:
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({rows[i][0] for i in plain_classes([t for _, t in rows])})
            assert docs.count() < before.count()
        if i == 2:
            want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect() if r["copies"]})
            assert Counter(r["doc_id"] for r in docs.collect()) == want
        if i < 3:
            assert docs.columns == columns
        if i == 3:
            sums = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            tokens = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
            copies = Counter(r["doc_id"] for r in before.collect())
            assert sums == {d: tokens[d] * copies[d] for d in copies}
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    json.dumps(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("stage", range(4))
def test_stages_over_odd_rows(spark, stage, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    columns = [f.name for f in DOCS] + ["_gone", "_hash", "_kept"]
    rows = [(*r, 1, 2, 3) for r in odd_rows()]
    for n, table in enumerate((rows, rows[:1], [(None,) * len(columns)] * 5, [])):
        docs = spark.createDataFrame(table, f"{DOCS.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, _gone int, _hash int, _kept int")
        out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
        out.write.parquet(f"{tmp_path}/{n}")
        got = spark.read.parquet(f"{tmp_path}/{n}")
        assert stage == 3 or got.columns == columns
        assert got.count() <= 3 * max(1, len(table)) or stage == 3
