import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import LoserTree, _line, archive_pages, capture, captures, history, index_run, members, merge_runs, parse, read_runs, url_key, write_archives


def pages_of(spark):
    rng = random.Random(3)
    rows = [(i, f"https://www.h{i % 4}.example/p/{i % 7}?x#y", f"<p>{rng.random()}</p>" if i % 3 else f"same {i % 2}") for i in range(200)]
    rows += [(200, None, None), (201, "", ""), (202, "http://a b\r\nX: y/", "é😀\r\n\r\nWARC/1.1\r\n"), (None, "http://n/", "same 0"), (None, "http://n/", "only null"), (3, "http://twice/", "same 1"), (203, "http://big/", "x" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_against_brute_force(spark):
    pages, rows = pages_of(spark)
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        first[h] = min(x for x in (i, first.get(h)) if x is not None) if (i, first.get(h)) != (None, None) else None
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = first[h] is not None and first[h] != i
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    index = archive_pages(pages, archive_bytes=3000)
    got = index.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    order = [(r["urlkey"], r["ts"], r["page_id"] is None, r["page_id"] or 0) for r in sorted(got, key=lambda r: r["place"])]
    assert order == sorted(order) and sorted(r["place"] for r in got) == list(range(len(rows)))
    assert {(r["page_id"], r["urlkey"]) for r in got} == {(i, url_key(_line(u))) for i, u, _ in rows}
    assert archive_pages(pages.limit(0)).count() == 0


def test_small_payloads_are_kept_apart(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"]) for r in archive_pages(pages, least_bytes=3).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_archives_are_gzip_members_that_any_reader_opens(spark):
    pages, rows = pages_of(spark)
    archives = write_archives(captures(pages), 5000).collect()
    assert len(archives) > 3 and len({a["archive"] for a in archives}) == len(archives)
    n = 0
    for a in archives:
        content = bytes(a["content"])
        whole = gzip.decompress(content)
        assert whole == b"".join(d for _, _, d in members(content, 100))
        run = index_run(a["archive"], content)
        for row in run:
            fields, block = parse(gzip.decompress(content[row[8] : row[8] + row[9]]))
            assert fields["warc-type"] == row[3] and (fields["warc-type"] == "revisit") == (block.endswith(b"\r\n\r\n") and row[6] is not None)
        n += len(run)
    assert n == len(rows)


def test_loser_tree_against_sorting():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_one_url_captured_very_often(spark):
    pages = spark.createDataFrame([(i, "http://hot/", str(i)) for i in range(3000)], "page_id long, url string, html string")
    runs = read_runs(write_archives(captures(pages), 10_000))
    assert runs.select("archive").distinct().count() > 10
    merged = history(runs, range_rows=200).collect()
    got = [(r["ts"], int(r["id"])) for r in sorted(merged, key=lambda r: r["place"])]
    assert len(got) == 3000 and got == sorted(got) and [r["place"] for r in sorted(merged, key=lambda r: r["place"])] == list(range(3000))
    sizes = [r["count"] for r in merge_runs(runs, 200).groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 800  # what a task holds doesn't follow the input


def test_an_index_row_leads_to_its_record(spark):
    pages, rows = pages_of(spark)
    archives = write_archives(captures(pages), 5000)
    contents = {a["archive"]: bytes(a["content"]) for a in archives.collect()}
    for r in history(read_runs(archives), 50).collect():
        fields, block = parse(gzip.decompress(contents[r["archive"]][r["offset"] : r["offset"] + r["length"]]))
        assert fields["warc-type"] == r["record_type"] and fields["warc-payload-digest"] == f"sha1:{r['payload_digest']}"
        assert r["id"] is None or fields["warc-record-id"] == f"<urn:x-capture:{r['id']}>"


def test_many_shared_payloads_spread(spark):
    pages, _ = pages_of(spark)
    few, many = (sorted(map(str, captures(pages, broadcast_rows=n).collect())) for n in (10**6, 0))
    assert few == many


def test_a_run_out_of_order_is_refused(spark):
    pages, _ = pages_of(spark)
    runs = read_runs(write_archives(captures(pages), 1 << 20))
    with pytest.raises(Exception, match="isn't sorted"):
        merge_runs(runs.withColumn("at", -F.col("at"))).collect()


def test_keys_and_damage():
    assert url_key("HTTP://www.Ex.ORG:80/A?b#c") == "org,ex:80)/a?b" and url_key(None) == "" and url_key("x.y") == "y,x)/"
    data = capture("1", "http://a/", "2024-01-01T00:00:00Z", b"payload", None, False)
    fields, block = parse(data)
    assert fields["warc-target-uri"] == "http://a/" and block.endswith(b"payload")
    for bad in (data[:-5], b"", b"x\r\n\r\n"):
        try:
            parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
