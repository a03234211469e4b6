"""MPEG audio as a column type: write payloads as layer III streams, and read any stream's structure exactly.

The reader finds frames by their headers and, where the bytes don't continue with a header that agrees with
the stream, searches for the next pair of agreeing headers (resynchronisation, with the skipped bytes counted).
It parses ID3v2, ID3v1 and APE tags and the Xing, Info and VBRI tables, verifies each protected frame's CRC-16 (over the
side information in layer III, the bit allocation in layer I, and that with the scale factor selection in layer II)
and gives the duration as a whole number of samples, without what the encoder says it put before and after, and the byte
offset of every frame. In streams of free format, whose headers name no bit rate, the distance of the first three headers that
agree gives the frames' length.

The writer carries bytes losslessly: each frame's main data is a run of payload bytes whose extent the
granules' part2_3_length fields state. All frames but the last have the highest bit rate, the last the lowest
that holds the rest; a Xing table with a seek table goes first, an ID3v2 tag states the payload's size. A payload
whose end would read as an ID3v1 or APE tag is followed by a silent frame, which no reader takes for one.

Defined cases: a null or empty text is a payload of padding alone; rows that repeat give equal streams; bytes
that are no MPEG audio give zero frames; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import id_type, map_batches, stored

# The header's tables. Bit rates in kbit/s by index 1 to 14, rates in Hz by index 0 to 2.
KBITS = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}
CRC_POLYNOMIAL = 0x8005
# What encoders that state delay and padding begin their name with, and how long a frame of free format may be.
ENCODERS = (b"LAME", b"Lavf", b"Lavc")
MOST_FREE = 8192
# Of layer II, how many subbands in turn have how many bits of allocation, by table.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ CRC_POLYNOMIAL if r & 0x8000 else r << 1) & 0xFFFF
        table.append(r)
    return table


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The checksum of a protected frame over its header's last two bytes and its side information."""
    table, r = _crc_table(), 0xFFFF
    for byte in data:
        r = (r << 8 & 0xFF00) ^ table[r >> 8 ^ byte]
    return r


def crc16_bits(data: bytes, bits: int) -> int:
    """The same over so many of the first bits."""
    r = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        r = (r << 1 ^ CRC_POLYNOMIAL if (r >> 15 ^ data[i // 8] >> 7 - i % 8) & 1 else r << 1) & 0xFFFF
    return r


def protected_bits(head: dict, body: bytes) -> int:
    """How many bits after the checksum of a frame it covers. body: what follows it."""
    if head["layer"] == 3:
        return 8 * head["side"]
    channels = 1 if head["mono"] else 2
    if head["layer"] == 1:
        bound = min(32, head["bound"])
        return 4 * (channels * bound + 32 - bound)
    each = head["kbit"] // channels
    if head["version"] != "1":
        table = "low"
    elif head["free"]:
        table = "a" if head["rate"] == 48000 else "b"
    elif each <= 48:
        table = "d" if head["rate"] == 32000 else "c"
    else:
        table = "a" if head["rate"] == 48000 or each <= 80 else "b"
    at, chosen, subband = 0, 0, 0
    content, size = int.from_bytes(body[:64], "big"), 8 * len(body[:64])
    for count, width in ALLOCATIONS[table]:
        for subband in range(subband, subband + count):
            joint = subband >= head["bound"]
            for _ in range(1 if joint else channels):
                if content >> max(0, size - at - width) & (1 << width) - 1:
                    chosen += channels if joint else 1
                at += width
        subband += 1
    return at + 2 * chosen


@lru_cache(65536)
def parse_header(head: bytes) -> dict | None:
    """What four bytes say as a frame header; None where they aren't one, or are of free format."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: "2.5", 2: "2", 3: "1"}.get(head[1] >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(head[1] >> 1 & 3)
    rate_at, kbit_at = head[2] >> 2 & 3, head[2] >> 4
    if version is None or layer is None or rate_at == 3 or not 0 < kbit_at < 15 or head[3] & 3 == 2:
        return None
    low = "1" if version == "1" else "2"
    kbit, rate, padded, mono = KBITS[low, layer][kbit_at - 1], RATES[version][rate_at], head[2] >> 1 & 1, head[3] >> 6 == 3
    samples = SAMPLES[low, layer]
    length = (12000 * kbit // rate + padded) * 4 if layer == 1 else samples * 125 * kbit // rate + padded
    side = 0 if layer < 3 else (17 if mono else 32) if low == "1" else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbit": kbit, "rate": rate, "samples": samples, "length": length, "side": side, "protected": not head[1] & 1, "mono": mono, "bound": 4 * (head[3] >> 4 & 3) + 4 if head[3] >> 6 == 1 else 32, "same": (version, layer, rate), "free": False}


def free_header(data: bytes, pos: int, end: int, slots: int | None = None) -> dict | None:
    """A header of free format at pos, and the frame's length by its bytes without padding (slots), or else by the next two headers that agree.

    The end of the stream stands for the third header. Found lengths are up to MOST_FREE bytes.
    """
    if pos + 4 > end or data[pos] != 0xFF or data[pos + 2] >> 4:
        return None
    likely = lambda at: parse_header(bytes([data[at], data[at + 1], data[at + 2] | 0x10, data[at + 3]])) if at + 4 <= end and data[at + 2] >> 4 == 0 else None
    head = likely(pos)
    if head is None:
        return None
    padding = lambda at: (data[at + 2] >> 1 & 1) * (4 if head["layer"] == 1 else 1)
    alike = lambda at: (other := likely(at)) is not None and (other["same"], other["mono"], other["protected"]) == (head["same"], head["mono"], head["protected"])
    at = pos + 4 + 2 * head["protected"] + head["side"]
    while slots is None:
        at = data.find(b"\xff", at, min(end, pos + MOST_FREE))
        if at < 0:
            return None
        after = at + (at - pos - padding(pos)) + (padding(at) if at + 4 <= end else 0)
        if alike(at) and (after == end or alike(after)):
            slots = at - pos - padding(pos)
        at += 1
    per_kbit = 12000 * 4 if head["layer"] == 1 else 125 * head["samples"]
    return head | {"free": True, "length": slots + padding(pos), "slots": slots, "kbit": round(slots * head["rate"] / per_kbit), "same": (*head["same"], "free", slots)}


@lru_cache(65536)
def main_data_bytes(side: bytes, version1: bool, mono: bool) -> int:
    """Bytes of main data that the granules of a layer III frame claim."""
    bits, channels = int.from_bytes(side, "big"), 1 if mono else 2
    width, at = 8 * len(side), (18 if mono else 20) if version1 else (9 if mono else 10)
    granule = 59 if version1 else 63
    return sum(bits >> width - at - g * granule - 12 & 0xFFF for g in range((2 if version1 else 1) * channels)) // 8


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def parse_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Start and end of what lies between the tags, and the tags' text frames."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and end - start >= 10:
        size, major = _syncsafe(data[start + 6 : start + 10]), data[start + 3]
        at, stop = start + 10, min(end, start + 10 + size)
        while at + 10 <= stop and re.fullmatch(rb"[A-Z0-9]{4}", name := data[at : at + 4]):
            n = _syncsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            if name[:1] == b"T" and n:
                body = data[at + 11 : at + 10 + n].decode({0: "latin-1", 3: "utf-8"}.get(data[at + 10], "utf-16"), "replace").split("\0")
                key, value = (f"TXXX:{body[0]}", body[1]) if name == b"TXXX" and len(body) > 1 else (name.decode(), body[0])
                tags[key] = value
            at += 10 + n
        start = min(end, start + 10 + size + 10 * (data[start + 5] >> 4 & 1))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["ID3v1:title"] = data[end - 125 : end - 95].split(b"\0")[0].decode("latin-1").rstrip()
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        end = max(start, end - int.from_bytes(data[end - 20 : end - 16], "little") - 32 * (data[end - 9] >> 7))
    return start, end, tags


def parse_table(frame: bytes, head: dict) -> dict | None:
    """A Xing, Info or VBRI table, if the frame is one: what it claims, with delay and padding in samples where an encoder states them, and its seek points.

    toc: of Xing, a hundredth of the duration each, in 256ths of the bytes; seek: of VBRI, bytes from the first frame to each entry's end,
    one for every `every` frames.
    """
    for at in (4 + head["side"], 6 + head["side"]):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(frame[p : p + n]) if name == "toc" else int.from_bytes(frame[p : p + n], "big")
                    p += n
            if frame[p : p + 4] in ENCODERS and len(frame) >= p + 24:
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI":
        part = lambda at, n: int.from_bytes(frame[at : at + n], "big")
        count, scale, width = part(54, 2), part(56, 2), part(58, 2)
        told = min(count, max(0, len(frame) - 62) // width) if 1 <= width <= 4 else 0  # a table that is cut off ends early
        seek = list(accumulate(part(62 + i * width, width) * scale for i in range(told)))
        return {"kind": "VBRI", "bytes": part(46, 4), "frames": part(50, 4), "delay": part(42, 2), "every": part(60, 2), "seek": seek}
    return None


def probe(data: bytes) -> dict:
    """Everything the reader knows of a stream; see the module's text."""
    start, end, tags = parse_tags(data)
    out = {"frames": 0, "samples": 0, "rate": 0, "crc_ok": 0, "crc_bad": 0, "skipped": 0, "resyncs": 0, "table": None, "tags": tags, "version": "", "layer": 0}
    offsets, rates, payload, pos, same, first, slots = [], [], [], start, None, True, None
    while pos + 4 <= end:
        head = parse_header(data[pos : pos + 4])
        if head is None and (same is None or slots is not None):
            head = free_header(data, pos, end, slots)
        fits = head is not None and pos + head["length"] <= end and (same is None or head["same"] == same)
        if fits and (same is None or out["lost"]):  # a first header counts only if the next one agrees
            after = pos + head["length"]
            following = free_header(data, after, end, head["slots"]) if head["free"] else parse_header(data[after : after + 4])
            fits = after == end or following is not None and following["same"] == head["same"]
        if not fits:
            out["resyncs"] += not out.get("lost")
            out["lost"] = True
            at = data.find(b"\xff", pos + 1, end)
            out["skipped"] += (at if at >= 0 else end) - pos
            pos = at if at >= 0 else end
            continue
        out["lost"], same, slots = False, head["same"], head.get("slots")
        body, length = pos + 4 + 2 * head["protected"], head["length"]
        side = data[body : body + head["side"]]
        if head["protected"]:
            told = int.from_bytes(data[pos + 4 : pos + 6], "big")
            if head["layer"] == 3:
                good = crc16(data[pos + 2 : pos + 4] + side) == told
            else:
                rest = data[body : pos + length]
                good = crc16_bits(data[pos + 2 : pos + 4] + rest[:64], 16 + protected_bits(head, rest)) == told
            out["crc_ok" if good else "crc_bad"] += 1
        if first and (table := parse_table(data[pos : pos + length], head)):
            out["table"] = table
        else:
            out["frames"] += 1
            out["samples"] += head["samples"]
            offsets.append(pos)
            rates.append(head["kbit"])
            if head["layer"] == 3:
                at = body + head["side"]
                payload.append(data[at : min(pos + length, at + main_data_bytes(side, head["version"] == "1", head["mono"]))])
        first = False
        pos += length
    if end - pos and pos < end:
        out["skipped"] += end - pos
    out.pop("lost", None)
    if same:
        out |= {"version": same[0], "layer": same[1], "rate": same[2]}
    delay, padding = ((out["table"] or {}).get(k, 0) for k in ("delay", "padding"))
    return out | {"heard": max(0, out["samples"] - delay - padding), "delay": delay, "padding": padding, "offsets": offsets, "kbits": rates, "payload": b"".join(payload), "start": start, "end": end}


_RATE_AT, _SIDE = 1, 17  # 48000 Hz; side information of one channel


def _frame_head(kbit: int, claims: tuple[int, int]) -> bytes:
    """Header, checksum and side information of a protected mono frame whose granules claim so many bits."""
    head = bytes([0xFF, 0xFA, (KBITS["1", 3].index(kbit) + 1) << 4 | _RATE_AT << 2, 0xC0])
    bits = 0
    for claim in claims:
        bits = bits << 59 | claim << 47 | 210 << 30  # part2_3_length, then a middling global gain
    side = (bits & (1 << 118) - 1).to_bytes(_SIDE, "big")
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _frame_bytes(kbit: int) -> int:
    return 144 * kbit // 48


def write_stream(payload: bytes) -> bytes:
    """A layer III stream that carries the payload; equal payloads give equal streams."""
    top, over = KBITS["1", 3][-1], 6 + _SIDE
    room, half = _frame_bytes(top) - over, 511
    full, rest = divmod(len(payload), room)
    parts = []
    if full:
        block = np.empty((full, room + over), dtype=np.uint8)
        block[:, :over] = np.frombuffer(_frame_head(top, (half * 8, (room - half) * 8)), dtype=np.uint8)
        block[:, over:] = np.frombuffer(payload, dtype=np.uint8, count=full * room).reshape(full, room)
        parts.append(block.tobytes())
    if rest:
        kbit = next(k for k in KBITS["1", 3] if _frame_bytes(k) - over >= rest)
        body = _frame_head(kbit, (min(rest, half) * 8, max(0, rest - half) * 8)) + payload[full * room :]
        parts.append(body.ljust(_frame_bytes(kbit), b"\0"))
    end = b"".join(p[-128:] for p in parts[-2:])[-128:]
    if end[:3] == b"TAG" or end[-32:-24] == b"APETAGEX":
        parts.append(_frame_head(48, (0, 0)).ljust(_frame_bytes(48), b"\0"))
    audio, frames = b"".join(parts), full + bool(rest) + len(parts) - bool(full) - bool(rest)
    size = len(audio) + _frame_bytes(48)
    starts = [j * (room + over) if j <= full else len(audio) - _frame_bytes(48) for j in (frames * i // 100 for i in range(100))]
    toc = bytes(min(255, 256 * (_frame_bytes(48) + at) // size) for at in starts)
    table = _frame_head(48, (0, 0)) + b"Xing" + (15).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame + table.ljust(_frame_bytes(48), b"\0") + audio


#: Bytes of streams or payloads that a task holds before it hands them on.
FLUSH_BYTES = 4 << 20


def to_media(docs: DataFrame, unit: int = 192, fill: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes, filled up to a positive multiple of unit, as a stream: (id, n_bytes, media), and of the stream what a
    player seeks by: samples and sample_rate (the exact duration is their ratio) and seek, the byte offset of each audio frame."""
    names = ["id", "n_bytes", "media", "samples", "sample_rate", "seek"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"], strict=True):
                data = (t or "").encode()
                media = write_stream(data.ljust(max(unit, -(-len(data) // unit) * unit), fill))
                found = probe(media)
                rows.append((i, len(data), media, found["samples"], found["rate"], found["offsets"]))
                held += len(media)
                if held >= FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    rows = map_batches(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), run, "id string, n_bytes long, media binary, samples long, sample_rate long, seek array<long>")
    return rows.select(F.col("id").cast(id_type(docs, id_col)).alias(id_col), *names[1:])


def store_media(docs: DataFrame, **options) -> DataFrame:
    """to_media as a table in the shared folder."""
    return stored(to_media(docs, **options), "media")


FOUND = (
    "payload binary, frames long, samples long, sample_rate long, duration_s double, crc_ok long, crc_bad long, skipped_bytes long, resyncs long, "
    "table_frames long, table_bytes long, kbit_min long, kbit_max long, frame_offsets array<long>, payload_claimed long, delay long, padding long, table_seek array<long>"
)


def _row(found: dict) -> tuple:
    table, kbits, rate, claimed = found["table"] or {}, found["kbits"], found["rate"], found["tags"].get("TXXX:payload_bytes", "")
    seconds = found["heard"] / rate if rate else 0.0
    return (
        found["payload"], found["frames"], found["samples"], rate, seconds, found["crc_ok"], found["crc_bad"], found["skipped"], found["resyncs"],
        table.get("frames", -1), table.get("bytes", -1), min(kbits, default=0), max(kbits, default=0), found["offsets"],
        int(claimed) if re.fullmatch("[0-9]{1,18}", claimed) else -1, found["delay"], found["padding"], table.get("seek", []),
    )


def read_media(media: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """What the stored bytes of each row hold: id, the columns to keep, media, and the columns of FOUND.

    duration_s is samples without delay and padding over rate; table_seek has the seek points of a VBRI table; table_frames and table_bytes are what the variable-bitrate table claims (-1: no
    table); frame_offsets is where each audio frame starts; payload_claimed is the payload's size by its tag (-1: no tag).
    """
    names = ["id", *keep, "media", *(c.split()[0] for c in FOUND.split(", "))]
    kept = "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                found = probe(row[-1] or b"")
                rows.append((*row, *_row(found)))
                held += 2 * len(row[-1] or b"")
                if held >= FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    rows = map_batches(media.select(F.col(id_col).cast("string").alias("id"), *keep, "media"), run, f"id string, {kept}media binary, {FOUND}")
    return rows.select(F.col("id").cast(id_type(media, id_col)).alias(id_col), *rows.columns[1:])
