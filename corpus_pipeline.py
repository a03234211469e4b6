"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Every stage takes all that its predecessor kept, as a table with the columns of `documents`; the last one returns pieces
of sequences. SQL cannot express recognising languages, near copies or tokens, so ORACLE_SQL is None and a brute-force
version checks the stages in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, near_copies, packing, simhash
from tidemark.llm._common import stored
from tidemark.llm.queries import VOCABULARY

#: Documents whose likeness to the nearest language's profile is lower are rejected, as are those without a letter, and those
#: whose label names another language than the one recognised. On sf0.1, strings of random letters score 0.10 to 0.23, the
#: documents 0.39 or more, and their first 50 letters alone 0.34 or more.
LEAST_SCORE = 0.3


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.learn(docs), LEAST_SCORE, lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, as op7, with what meets checked by Jaccard; texts that are near by Jaccard but not by 4 bits meet on bands as well."""
    return simhash.keep_one(docs, find=near_copies.near_copies)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_languages),
    ("near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
