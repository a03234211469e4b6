import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.mpeg_audio import crc16, parse_header, probe, read_media, store_media, to_media, write_stream


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=5000))
def test_round_trip(payload):
    found = probe(write_stream(payload))
    assert found["payload"] == payload
    assert found["crc_bad"] == found["skipped"] == found["resyncs"] == 0
    assert found["samples"] == 1152 * found["frames"] == 1152 * (found["table"]["frames"])
    assert found["tags"] == {"TXXX:payload_bytes": str(len(payload))}
    assert found["table"]["bytes"] == found["end"] - found["start"]


def test_resynchronises_after_junk_and_counts_damage():
    payload = bytes(range(256)) * 20
    stream = write_stream(payload)
    clean = probe(stream)
    at = clean["offsets"][2]
    junk = probe(stream[:at] + b"\xff\xfbjunk\xff" + stream[at:])
    assert junk["payload"] == payload and junk["skipped"] == 7 and junk["resyncs"] == 1
    assert junk["offsets"][2] == at + 7 and junk["samples"] == clean["samples"]
    hurt = bytearray(stream)
    hurt[at + 8] ^= 1  # side information
    assert probe(bytes(hurt))["crc_bad"] == 1
    cut = probe(stream[:-10])
    assert cut["frames"] == clean["frames"] - 1 and cut["skipped"] > 0


def test_headers():
    head = parse_header(bytes([0xFF, 0xFB, 0x90, 0x64]))  # 128 kbit/s, 44.1 kHz, joint stereo, unprotected
    assert (head["length"], head["samples"], head["side"], head["protected"]) == (417, 1152, 32, False)
    assert parse_header(bytes([0xFF, 0xF3, 0x40, 0xC0]))["length"] == 144 // 2 * 32000 // 22050
    assert parse_header(b"\xff\xff\xff\xff") is None and parse_header(b"RIFF") is None and parse_header(b"") is None
    assert crc16(b"") == 0xFFFF and crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_tags_of_other_writers():
    stream = write_stream(b"x" * 3000)
    body = stream[probe(stream)["start"] :]
    other = b"ID3\x04\0\0\0\0\0\x0d" + b"TIT2\0\0\0\x03\0\0\x00ab" + body + b"TAG" + b"title".ljust(125, b"\0")
    found = probe(other)
    assert found["tags"]["ID3v1:title"] == "title" and found["tags"]["TIT2"] == "ab" and found["payload"] == b"x" * 3000


def test_no_audio():
    for data in (b"", b"\xff", b"plain text", b"\xff" * 5000):
        assert probe(data)["frames"] == 0


def test_table(odd, none):
    rows = read_media(to_media(odd)).collect()
    want = sorted(t.encode().ljust(max(192, -(-len(t.encode()) // 192) * 192)) for t in ((r["text"] or "") for r in odd.collect()))
    assert sorted(bytes(r["payload"]) for r in rows) == want
    assert all(r["n_bytes"] <= len(r["payload"]) and len(r["frame_offsets"]) == r["frames"] == r["crc_ok"] - 1 for r in rows)
    assert read_media(to_media(none)).count() == 0


def test_payloads_that_end_like_tags():
    """TAG and APETAGEX where the stream's 128th and 32nd last bytes come to lie, for every frame size and for full frames."""
    for size in (192, 576, 937, 960, 2 * 937, 3 * 192 * 5):
        clean = bytes(b"lorem ipsum " * 300)[:size]
        for mark in (b"TAG", b"APETAGEX"):
            for at in range(max(0, size - 260), size - len(mark)):
                payload = clean[:at] + mark + clean[at + len(mark) :]
                found = probe(write_stream(payload))
                assert found["payload"] == payload and found["skipped"] == 0 and found["tags"] == {"TXXX:payload_bytes": str(size)}, (size, mark, at)
                assert found["frames"] == found["table"]["frames"] and found["table"]["bytes"] == found["end"] - found["start"]


def bit_by_bit(bits):
    r = 0xFFFF
    for b in bits:
        r = (r << 1 ^ (0x8005 if r >> 15 ^ b else 0)) & 0xFFFF
    return r


@pytest.mark.parametrize("layer, mode, kbit_at, rate_at, covered", [
    (1, 3, 4, 0, lambda a: 128), (1, 0, 4, 0, lambda a: 256), (1, 1, 4, 0, lambda a: 4 * 36),  # joint stereo from subband 4 on
    (2, 3, 8, 0, lambda a: 11 * 4 + 12 * 3 + 7 * 2 + 2 * a), (2, 3, 1, 2, lambda a: 2 * 4 + 10 * 3 + 2 * a), (2, 0, 8, 1, lambda a: 2 * (11 * 4 + 12 * 3 + 4 * 2) + 2 * a),
])
def test_checksums_of_layers_one_and_two(layer, mode, kbit_at, rate_at, covered):
    head = bytes([0xFF, 0xF8 | {1: 6, 2: 4}[layer], kbit_at << 4 | rate_at << 2, mode << 6])
    length = parse_header(head)["length"]
    frames = b""
    for first in (0, 0b10010000):  # no subband is allocated, or the first one
        body = bytes([first]).ljust(length - 6, b"\0")
        bits = [x >> 7 - k & 1 for x in head[2:] + body for k in range(8)][: 16 + covered(bool(first) if layer == 2 else 0)]
        frames += head + bit_by_bit(bits).to_bytes(2, "big") + body
    found = probe(frames)
    assert (found["frames"], found["crc_ok"], found["crc_bad"]) == (2, 2, 0)
    broken = bytearray(frames)
    broken[6] ^= 0x40
    assert probe(bytes(broken))["crc_bad"] == 1


def test_durations_and_offsets_are_stored(odd):
    for r in store_media(odd).collect():
        found = probe(bytes(r["media"]))
        assert (r["samples"], r["sample_rate"], r["seek"]) == (found["samples"], found["rate"], found["offsets"]) and r["samples"] == 1152 * len(r["seek"])


def free_frames(n, length, head=b"\xff\xfb\x00\xc0", every=3, slot=1):
    """Frames of free format, every third padded by a slot; their bytes hold single 0xFF and headers of other kinds."""
    out = []
    for i in range(n):
        padded = i % every == 1
        h = bytes([head[0], head[1], head[2] | (2 if padded else 0), head[3]])
        body = b"\0" * 40 + (b"\xff\x00\xff\xfb\x90\x64" + bytes([i])) * (length // 8)
        out.append(h + body[: length - 4 + slot * padded].ljust(length - 4 + slot * padded, b"\0"))
    return out


@pytest.mark.parametrize("head, layer, slot, length", [(b"\xff\xfb\x00\xc0", 3, 1, 700), (b"\xff\xf3\x04\x40", 3, 1, 131), (b"\xff\xff\x08\xc0", 1, 4, 400), (b"\xff\xfd\x04\xc0", 2, 1, 1500)])
def test_free_format(head, layer, slot, length):
    frames = free_frames(9, length, head, slot=slot)
    found = probe(b"".join(frames))
    starts = [sum(map(len, frames[:i])) for i in range(9)]
    assert (found["frames"], found["layer"], found["offsets"], found["skipped"]) == (9, layer, starts, 0)
    per = {1: 384, 2: 1152, 3: 1152 if found["version"] == "1" else 576}[layer]
    assert found["samples"] == found["heard"] == 9 * per
    assert found["kbits"][0] == round(length * found["rate"] / per / 125)
    # Lost bytes are skipped until two headers of the known length follow; tags at either end don't count.
    hurt = b"ID3\x04\0\0\0\0\0\x00" + b"".join(frames[:4]) + b"junk\xff" + b"".join(frames[4:]) + b"TAG" + b"\0" * 125
    again = probe(hurt)
    assert (again["frames"], again["skipped"], again["resyncs"]) == (9, 5, 1)
    assert probe(frames[0])["frames"] == 0  # alone it has no length


def test_checksum_in_free_format():
    head, rest = b"\xff\xfa\x00\xc0", b"\0" * 17
    frame = (head + crc16(head[2:] + rest).to_bytes(2, "big") + rest).ljust(500, b"\1")
    found = probe(frame * 4)
    assert (found["frames"], found["crc_ok"], found["crc_bad"]) == (4, 4, 0)
    assert probe(frame * 3 + frame[:8] + b"\7" + frame[9:])["crc_bad"] == 1


def test_delay_and_padding_of_an_encoder():
    head = b"\xff\xfb\x90\x64"  # 417 bytes, 32 of side information
    info = b"Info" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes(100) + bytes(4)
    told = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    stream = lambda tag: (head + bytes(32) + info + tag).ljust(417, b"\0") + (head.ljust(417, b"\0")) * 3
    found = probe(stream(told))
    assert (found["frames"], found["samples"], found["heard"], found["delay"], found["padding"]) == (3, 3456, 3456 - 1576, 576, 1000)
    other = probe(stream(b"other".ljust(24, b"\1")))
    assert (other["heard"], other["delay"], other["padding"], other["table"]["frames"]) == (3456, 0, 0, 3)


@pytest.mark.parametrize("width, scale", [(1, 100), (2, 3), (4, 1)])
def test_seek_table_of_vbri(width, scale):
    head = b"\xff\xfb\x90\x64"
    steps = [5, 9, 200, 1]
    number = lambda v, n: v.to_bytes(n, "big")
    table = b"VBRI" + number(1, 2) + number(1105, 2) + number(75, 2) + number(1668, 4) + number(3, 4) + number(4, 2) + number(scale, 2) + number(width, 2) + number(1, 2)
    whole = (head + bytes(32) + table + b"".join(number(v, width) for v in steps)).ljust(417, b"\0")
    found = probe(whole + head.ljust(417, b"\0") * 3)
    assert found["table"] == {"kind": "VBRI", "bytes": 1668, "frames": 3, "delay": 1105, "every": 1, "seek": [5 * scale, 14 * scale, 214 * scale, 215 * scale]}
    assert found["heard"] == 3 * 1152 - 1105
    broken = whole[:54] + number(60000, 2) + whole[56:]  # claims more entries than the frame holds
    assert len(probe(broken + head.ljust(417, b"\0") * 3)["table"]["seek"]) == (417 - 62) // width
    none = whole[:58] + number(9, 2) + whole[60:]
    assert probe(none + head.ljust(417, b"\0") * 3)["table"]["seek"] == []


def test_foreign_streams_as_rows(spark):
    rows = [(1, b"".join(free_frames(5, 300))), (2, None), (3, b"\xff\xfb\x00\xc0"), (4, write_stream(b"a" * 192))]
    found = {r["doc_id"]: r for r in read_media(spark.createDataFrame(rows, "doc_id long, media binary"), keep=()).collect()}
    assert found[1]["frames"] == 5 and found[1]["duration_s"] == 5 * 1152 / 44100 and found[2]["frames"] == found[3]["frames"] == 0
    assert bytes(found[4]["payload"]) == b"a" * 192 and (found[4]["delay"], found[4]["padding"], found[4]["table_seek"]) == (0, 0, [])
