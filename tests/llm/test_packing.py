import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import Encoder, first_fit_decreasing, pack, sequences, top_up

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_tree_places_as_plain_first_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 100, 513):
        sizes = np.sort(rng.integers(1, 65, n))[::-1]
        where, at = first_fit_decreasing(sizes, 64)
        room, plain = [], []
        for s in sizes.tolist():
            i = next((i for i, r in enumerate(room) if r >= s), len(room))
            if i == len(room):
                room.append(64)
            plain.append((i, 64 - room[i]))
            room[i] -= s
        assert list(zip(where.tolist(), at.tolist(), strict=True)) == plain


def test_topping_up_keeps_every_token_and_saves_bins():
    rng = np.random.default_rng(5)
    for n, low, high in ((0, 1, 2), (1, 5, 6), (2, 600, 700), (300, 30, 90), (300, 300, 420), (50, 513, 520)):
        sizes = np.sort(rng.integers(low, high, n))[::-1]
        where, at = first_fit_decreasing(sizes, 1024)
        piece, inside, size, bins, offset = top_up(sizes, where, at, 1024)
        for i in range(n):
            own = sorted(zip(inside[piece == i].tolist(), size[piece == i].tolist(), strict=True))
            assert [a for a, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))] and sum(s for _, s in own) == sizes[i]
        for b in set(bins.tolist()):
            end = 0
            for o, s in sorted(zip(offset[bins == b].tolist(), size[bins == b].tolist(), strict=True)):
                assert o == end
                end += s
            assert end <= 1024
        assert len(set(bins.tolist())) <= len(set(where.tolist()))
        if high == 520:
            assert len(set(bins.tolist())) == 26  # all but one of the bins held a single piece


def test_ids_are_the_tokenizers(tokenizer):
    encode = Encoder(PATH)
    for t in ("", " ", "Hello  world's\n\n 123", "a" * 3000, "É ß ﬁ 漢字 😀", "x <|endoftext|> y", "\u00a0\u2003z", "don't\t\tstop"):
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(odd, tokenizer):
    rows = pack(odd, PATH, capacity=256, group_bytes=20_000).collect()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    streams = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for _, _, t in texts]
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"] is None, r["doc_id"] or 0), []).append(r)
    for key in {(a, b) for a, b, _ in texts}:
        want = sorted(s for (a, b, _), s in zip(texts, streams, strict=True) if (a, b) == key)
        assert sum(map(len, want)) == 4 * sum(r["length"] for r in pieces[key])
        if len(want) == 1:
            own = sorted(pieces[key], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in own) == want[0]
            assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
            assert {r["doc_tokens"] for r in own} == {len(want[0]) // 4}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256


def test_little_padding(spark, sf):
    rows = pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH)
    tokens, n = rows.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert tokens / (1024 * n) > 0.995


def test_sequences_are_padded_unless_a_power_of_two(odd):
    for r in sequences(pack(odd, PATH, capacity=256), 256).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 256)


def test_empty(none):
    assert pack(none, PATH).count() == 0


def test_crc(odd):
    got = pack(odd, PATH).select("ids", F.crc32("ids").alias("c")).first()
    assert got["c"] == zlib.crc32(bytes(got["ids"]))


def test_copies_spread_alike_however_rows_are_split(spark):
    """Rows that repeat, some of them very often, get the same groups over any partitioning."""
    rows = [(7, "same text under one id")] * 3000 + [(i % 40, f"text {i % 80}") for i in range(1000)] + [(None, "no id")] * 50 + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def packed(parts):
        pieces = pack(docs.repartition(parts), PATH, group_bytes=4096)
        return sorted((tuple(r) for r in pieces.select("doc_id", "start", "length", "sequence_id", "offset").collect()), key=repr)

    one = packed(1)
    assert len({r[3] // 1 for r in one if r[0] == 7}) > 5
    assert packed(7) == one
