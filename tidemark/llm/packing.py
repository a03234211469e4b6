"""Pack token streams of documents into fixed-length training sequences.

Documents are tokenised with a byte-level BPE vocabulary, ended by a separator id and cut into full pieces
of the capacity and one remainder. Documents are dealt at random into groups of bounded size; in each group
the pieces are placed by first-fit decreasing, where a tournament tree over the bins' free capacity finds the
leftmost bin that fits in logarithmic time. Larger gaps that remain take the emptiest bins' pieces, cut to fit.
Groups share nothing, so they run wherever there is a core.

Defined cases: a null or empty text is the separator alone; rows that repeat are packed as often as they
occur; a null id is kept as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import id_type, map_batches, numbered_copies

# Fixed value: how byte-level BPE vocabularies of this family cut text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes of ids that a tokenising task holds before it hands them on.
FLUSH_BYTES = 4 << 20


class Encoder:
    """Ids as the `tokenizers` library gives them for the vocabulary file, through a faster merge loop.

    Two libraries can differ on characters whose Unicode class is young, so a text with any character
    beyond Latin Extended-B, or with the name of a special token, is encoded by `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("pack", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([r"[^\x00-ɏ]", *map(re.escape, special)]))
        self.size = 1 + max(i for i in spec["model"]["vocab"].values())

    def __call__(self, text: str) -> list[int]:
        if self.odd.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, however many tasks that runs."""
    return Encoder(path)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity), placed in the order given, which should be descending.

    The tree's leaves hold the free room of the bins, inner nodes the larger of their children; going down
    to the left wherever the left child has room ends at the first bin that fits.
    """
    n = len(sizes)
    where, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    full = int(np.searchsorted(-sizes, -capacity, side="right"))  # those fill a bin each
    where[:full] = np.arange(full)
    leaves = 1 << max(0, (n - full - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for i, size in enumerate(sizes[full:].tolist(), full):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        where[i], at[i] = full + node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return where, at


def top_up(sizes: np.ndarray, where: np.ndarray, at: np.ndarray, capacity: int, least_gap: int = 16) -> tuple[np.ndarray, ...]:
    """Dissolve the emptiest bins into gaps of at least least_gap in the others, as many as fit there whole.

    Returns, for each part: index of the piece, offset in it, size, bin and offset in the bin. Only pieces of
    dissolved bins are cut.
    """
    filled = np.bincount(where, weights=sizes).astype(np.int64)
    gap = np.where(capacity - filled >= least_gap, capacity - filled, 0)
    order = np.argsort(filled, kind="stable")
    fits = np.cumsum(filled[order]) <= gap.sum() - np.cumsum(gap[order])
    gone = order[: int(np.argmin(fits)) if not fits.all() else max(0, len(order) - 1)]
    moved = np.isin(where, gone)
    room = [(b, int(gap[b])) for b in sorted(set(range(len(filled))) - set(gone.tolist()), key=lambda b: (gap[b], b)) if gap[b]]
    parts = []
    for i in np.flatnonzero(moved).tolist():
        done = 0
        while done < sizes[i]:
            b, free = room.pop()
            take = min(free, int(sizes[i]) - done)
            parts.append((i, done, take, b, capacity - free))
            done += take
            if free > take:
                room.append((b, free - take))
    kept = np.flatnonzero(~moved)
    whole = np.stack([kept, np.zeros(len(kept), dtype=np.int64), sizes[kept], where[kept], at[kept]])
    return tuple(np.concatenate([whole, np.array(parts, dtype=np.int64).reshape(-1, 5).T], axis=1))


def token_streams(rows: DataFrame, vocabulary: str, groups: int, seed: int, separator: int = 0) -> DataFrame:
    """(id, grp, ids) of rows (id, text, copy): the ids of each document and its random group; copies spread over the groups, too. ids are little-endian, 2 bytes each if the vocabulary allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        encode = encoder(vocabulary)
        kind = "<u2" if encode.size <= 1 << 16 else "<u4"
        names = ["id", "grp", "width", "ids"]
        rows, held = [], 0
        for batch in batches:
            for i, t, copy in zip(batch["id"], batch["text"], batch["copy"], strict=True):
                ids = np.array([*encode(t or ""), separator], dtype=kind).tobytes()
                key = xxhash.xxh64_intdigest(ids, xxhash.xxh64_intdigest(str(i).encode(), seed))
                rows.append((i, xxhash.xxh64_intdigest(f"{key} {copy + 1}".encode(), seed) % groups, int(kind[-1]), ids))
                held += len(ids)
                if held >= FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return map_batches(rows, run, "id string, grp long, width int, ids binary")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, group_bytes: int = 8 << 20, least_gap: int = 16, seed: int = 41, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    group_bytes: text in a group, which bounds what a task holds; a group always takes whole documents. least_gap: padding
    of at least that many tokens is filled with cut pieces of the emptiest sequences where that saves sequences.
    """
    rows, total = numbered_copies(docs, id_col, text_col)  # ids as strings: null ones stay apart from numbers
    streams = token_streams(rows, vocabulary, max(1, -(-total // group_bytes)), seed, separator)
    kind = id_type(docs, id_col)

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        streams = [np.frombuffer(x, dtype=f"<u{w}") for x, w in zip(rows["ids"], rows["width"], strict=True)]
        lengths = np.array([len(x) for x in streams])
        pieces = -(-lengths // capacity)
        doc = np.repeat(np.arange(len(rows)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        size = np.minimum(capacity, lengths[doc] - start)
        name = rows["id"].fillna("").to_numpy().astype(str)
        content = np.array([hash_of(x) for x in rows["ids"]], dtype=np.uint64)
        order = np.lexsort((start, content[doc], name[doc], -size))
        doc, start, size = doc[order], start[order], size[order]
        where, at = first_fit_decreasing(size, capacity)
        piece, inside, size, where, at = top_up(size, where, at, capacity, least_gap)
        doc, start = doc[piece], start[piece] + inside
        return pd.DataFrame({
            "id": rows["id"].to_numpy()[doc], "start": start, "length": size, "doc_tokens": lengths[doc],
            "sequence_id": (int(key[0]) << 32) + where, "offset": at,
            "ids": [streams[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, size, strict=True)],
        })

    def hash_of(x: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(x)

    packed = streams.groupBy("grp").applyInPandas(group, "id string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return packed.select(F.col("id").cast(kind).alias(id_col), *packed.columns[1:])


def sequences(packed: DataFrame, capacity: int = 1024, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences as they are fed to a model, padded to the capacity unless their length is a power of two."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = b"".join(rows["ids"])
        n = len(ids) // 4
        if n & (n - 1):
            ids += int(pad).to_bytes(4, "little") * (capacity - n)
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [n], "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids binary")
