"""Filter URLs by rules kept as a sorted array of 64-bit digests.

The rule set is a file: the sorted xxhash64 keys of the rules' `host/path` strings, and beside them verdicts and
the strings themselves. Workers map the file into memory, so the pages are shared between processes and read on
demand. A batch of URLs becomes an array of candidate keys (each parent domain of as many labels as some rule's host, with
each path prefix as long as some rule's path), probed by one vectorised binary search per batch; hits are confirmed on the stored strings.

Defined cases: a null URL or one without `://` has an empty host and path and fits no rule; the longest fitting
rule wins, between equal lengths the one of the longer host; what no rule fits gets the default verdict; an
empty rule set or table is fine; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import id_type, map_batches, put_shared

MAGIC = b"digests2"


def build_index(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index file of (rule, verdict) pairs; a rule is `host/path prefix`, a verdict `allow` or `block`.

    Layout, little-endian: magic, count, number of path lengths, number of label counts, those lengths, those counts, keys, string ends,
    verdicts, strings.
    A rule given twice keeps its last verdict.
    """
    import xxhash

    last = {r.encode(): v for r, v in rules}
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in last.items())
    lengths = sorted({len(r.decode().partition("/")[2]) + 1 for _, r, _ in rows})
    depths = sorted({r.decode().partition("/")[0].count(".") + 1 for _, r, _ in rows})
    ends = np.cumsum([len(r) for _, r, _ in rows], dtype="<u8")
    numbers = [np.array([len(rows), len(lengths), len(depths), *lengths, *depths], dtype="<u8"), np.array([k for k, _, _ in rows], dtype="<u8"), ends, np.array([v == "block" for _, _, v in rows], dtype="<u8")]
    return MAGIC + b"".join(x.tobytes() for x in numbers) + b"".join(r for _, r, _ in rows)


class Index:
    """A mapped index file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is no digest index")
        n, k, m = (int(x) for x in data[8:32].view("<u8"))
        at = 32 + 8 * (k + m)
        self.lengths = data[32 : 32 + 8 * k].view("<u8").astype(int).tolist()
        self.depths = data[32 + 8 * k : at].view("<u8").astype(int).tolist()
        self.keys, self.ends, self.block = (data[at + 8 * n * i : at + 8 * n * (i + 1)].view("<u8") for i in range(3))
        self.strings = data[at + 24 * n :]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, keys: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """The row of each key whose stored string is the one given, else -1."""
        out = np.full(len(keys), -1)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
                i = int(at[j])
                while i < len(self.keys) and self.keys[i] == keys[j]:  # strings that share a digest lie side by side
                    if self.string(i) == strings[j]:
                        out[j] = i
                        break
                    i += 1
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def candidates(host: str, path: str, lengths: list[int], depths: list[int]) -> list[str]:
    """What a rule could say that fits: each parent domain of as many labels, with each prefix as long, as some rule's.

    depths is sorted; no more of the host is taken apart than the rule of most labels has.
    """
    labels = host.rsplit(".", depths[-1])[-depths[-1] :] if host and depths else []
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [f"{'.'.join(labels[-d:])}{p}" for d in depths if d <= len(labels) for p in prefixes if p[:1] == "/"]


def judge(batch: pd.Series, index: Index, default: str) -> pd.DataFrame:
    import xxhash

    cut = [parts(u) for u in batch]
    strings, owner = [], []
    for i, (host, path) in enumerate(cut):
        own = [c.encode() for c in candidates(host, path, index.lengths, index.depths)]
        strings += own
        owner += [i] * len(own)
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], dtype=np.uint64)
    found = index.find(keys, strings)
    best: dict[int, tuple[int, int, int]] = {}
    for j in np.flatnonzero(found >= 0).tolist():
        s = strings[j].decode()
        best[owner[j]] = max(best.get(owner[j], (-1, 0, 0)), (len(s), s.index("/"), j))
    rules = [strings[best[i][2]].decode() if i in best else None for i in range(len(cut))]
    verdicts = [("block" if index.block[found[best[i][2]]] else "allow") if i in best else default for i in range(len(cut))]
    return pd.DataFrame({"host": [h for h, _ in cut], "path": [p for _, p in cut], "rule": rules, "verdict": verdicts})


def publish(spark: SparkSession, index: bytes) -> str:
    """Put an index in the shared folder and have every executor, also one that joins later, fetch it. Its file name."""
    name = f"digests-{uuid.uuid4().hex}.idx"
    spark.sparkContext.addFile(put_shared(spark, name, index))
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row. No shuffle: the work is one pass over the URLs."""
    name = publish(pages.sparkSession, build_index(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            out = judge(batch["url"], index, default)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = map_batches(pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url")), run, "id string, host string, path string, rule string, verdict string")
    return rows.select(F.col("id").cast(id_type(pages, id_col)).alias(id_col), "host", "path", "rule", "verdict")
