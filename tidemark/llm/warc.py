"""Web archives: write WARC records, read them back and merge the captures' indexes into global order.

Captures are written as gzip members, one a record, into archives of bounded size; an archive is a row of a
table in the shared folder, so that Spark commits it once however often a task is repeated. Equal payloads are
stored once: the capture of the least id is the response, the others are revisits that refer to it.

Reading an archive gives its captures as a locally sorted run (URL key, timestamp, id). Runs are cut at the same bounds
into slices; bounds are drawn from the runs so that a range has about `range_rows` rows however many there are (a URL captured
very often spreads by time and id, a capture that repeats by its place in the archives). A range's slices come
sorted by run and place from Spark's external sort, and a tree of losers merges them, which replays one path of log2 k
matches for each row. Ranges in order are the global capture history, and `place` numbers it from 0.

Defined cases: a null payload is empty; a null URL has the empty key; a null id sorts last and is never referred to
unless a payload has no other (then all its captures are responses), as are all rows of the least id where it repeats;
empty tables and extra columns are fine.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_if_small, id_type, map_batches, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, ts string, id string, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string, offset long, length long"
#: Copies of each shared payload's entry, over which captures of one payload spread where the entries are too many to broadcast.
SALT = 16


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, scheme, fragment and `www.` dropped, A-Z lower-cased."""
    if not url:
        return ""
    rest = (url.partition("://")[2] if "://" in url else url).translate(_LOWER)
    host = re.match(r"[^/?#]*", rest)[0]
    name, _, port = host.partition(":")
    labels = name.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}{':' + port if port else ''}){rest[len(host) :].partition('#')[0] or '/'}"


def record(kind: str, fields: Sequence[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(text: str | None) -> str | None:
    return None if text is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def capture(id_: str | None, url: str | None, ts: str, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """The record of a capture. A revisit keeps the HTTP headers, whose Content-Length tells the full payload's size."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda x: None if x is None else f"<urn:x-capture:{x}>"
    fields = [("WARC-Record-ID", name(id_)), ("WARC-Date", ts), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))] * revisit + [("Content-Type", "application/http;msgtype=response")]
    return record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased, `type` among them) and block of a record; ValueError if it's none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member."""
    at = 0
    while at < len(content):
        z, parts, fed = zlib.decompressobj(31), [], at
        while not z.eof:
            if fed >= len(content):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(content[fed : fed + step]))
            fed += step
        end = min(fed, len(content)) - len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def index_run(archive: str, content: bytes) -> list[tuple]:
    """The captures of an archive, sorted; payloads of responses are held against their digests."""
    rows = []
    for offset, length, data in members(content):
        fields, block = parse(data)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
        name = lambda k: m[1] if (m := re.fullmatch(r"<urn:x-capture:(.*)>", fields.get(k, ""))) else None
        rows.append((url_key(fields.get("warc-target-uri")), fields["warc-date"], name("warc-record-id"), kind, size, digest, name("warc-refers-to"), archive, offset, length))
    return sorted(rows, key=order)


def order(row: Sequence) -> tuple:
    """URL key, timestamp, id (numbers by value, missing last)."""
    i = row[2]
    return row[0], row[1], i is None, (0, int(i), "") if i is not None and re.fullmatch(r"-?\d{1,30}", i) else (1, 0, i or ""), row[7], row[8]


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, the winner goes up."""

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [0] * self.k
        winner = [0] * (2 * self.k)
        for i in range(self.k):
            winner[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winner[1] if self.k > 1 else 0

    def _head(self, i: int):
        return self.key(self.runs[i][self.at[i]]) if i < len(self.runs) and self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            node = (self.k + i) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def captures(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: Column | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, url, ts, payload, refers_to, revisit): which capture keeps each payload of at least least_bytes.

    ts: time of capture (text of a fixed form); by default a time that follows from the id.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seconds = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % 31_536_000
    at = ts if ts is not None else F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), at.alias("ts"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    shared = stored(shared.select(F.col("digest").alias("shared"), "first"), "shared-payloads")
    same = F.col("digest") == F.col("shared")
    if shared.count() > broadcast_rows:
        shared = shared.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALT)).cast("int")).join(shared, same & (F.col("salt") == F.col("turn")), "left")
    else:
        joined = rows.join(F.broadcast(shared), same, "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("id", "url", "ts", "payload", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def write_archives(found: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive, content): the captures as archives of about archive_bytes, stored in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = member(record("warcinfo", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        parts, size, count, task = [info], len(info), 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.itertuples(index=False):
                parts.append(member(capture(row.id, row.url, row.ts, row.payload, row.refers_to, bool(row.revisit))))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [f"captures-{task:06d}-{count:06d}.warc.gz"], "content": [b"".join(parts)]})
                    parts, size, count = [info], len(info), count + 1
        if len(parts) > 1:
            yield pd.DataFrame({"archive": [f"captures-{task:06d}-{count:06d}.warc.gz"], "content": [b"".join(parts)]})

    text = found.select(F.col("id").cast("string").alias("id"), "url", "ts", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return stored(map_batches(text, run, "archive string, content binary"), "archives")


def read_runs(archives: DataFrame) -> DataFrame:
    """Index rows of all archives with their place `at` in the archive's sorted run, stored so that dealing them by ranges reads no archive again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"], strict=True):
                rows = pd.DataFrame(index_run(archive, content), columns=names)
                yield rows.assign(at=range(len(rows)))

    return stored(map_batches(archives.select("archive", "content"), run, f"{INDEX}, at long"), "runs")


def merge_runs(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """The runs' rows with `range` and `at`, the place in it: ranges in order, and in each the slices of the runs merged by a tree of losers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list] = {}
        columns, number, done = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = list(batch.columns)
            for row in batch.itertuples(index=False, name=None):
                slices.setdefault(row[7], []).append(tuple(None if x is None or x != x else x for x in row))
        if columns:
            out, last = [], None
            for row in LoserTree(list(slices.values()), order):
                if last is not None and order(row) < last:
                    raise ValueError(f"the run of {row[7]} isn't sorted")
                last = order(row)
                out.append(row)
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=columns).assign(range=number, at=np.arange(done, done + len(out)))
                    out, done = [], done + len(out)
            yield pd.DataFrame(out, columns=columns).assign(range=number, at=np.arange(done, done + len(out)))

    number = F.col("id").cast("decimal(38,0)")
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", F.when(F.col("id").isNull(), 2).when(number.isNull(), 1).otherwise(0), number, "id", "archive", "offset")
    slices = dealt.sortWithinPartitions("archive", "at").drop("at")
    return map_batches(slices, run, f"{INDEX}, range int, at long")


def history(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """The merged index with `place`, each capture's place in the global order, without gaps from 0."""
    merged = stored(merge_runs(runs, range_rows), "history")
    counts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = stored(counts.select(F.col("range").alias("_range"), F.coalesce(before, F.lit(0)).alias("_start")), "history-starts")
    return merged.join(broadcast_if_small(starts, 500_000), F.col("range") == F.col("_range")).select(*(x.split()[0] for x in INDEX.split(", ")), (F.col("_start") + F.col("at")).alias("place"))


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 4 << 20, range_rows: int = 100_000, id_col: str = "page_id", **columns) -> DataFrame:
    """Write pages as archives, read these back and return the global capture history, each capture with where its record lies."""
    index = history(read_runs(write_archives(captures(pages, least_bytes, id_col, **columns), archive_bytes)), range_rows)
    kind = id_type(pages, id_col)
    return index.select(F.col("id").cast(kind).alias(id_col), *[c for c in index.columns if c not in ("id", "refers_to")], F.col("refers_to").cast(kind).alias("refers_to"))
