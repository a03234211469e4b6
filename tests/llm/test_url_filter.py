import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import Index, build_index, candidates, filter_urls, parts

HOSTS = ["org", "example.org", "EXAMPLE.Org", "a.example.org", "badexample.org", "x.com", "com", "y.net", ""]
PATHS = ["", "/", "/es/1", "/es", "/en/1", "/en/12?q=/es/", "/fr/x#t", "/de/", "?a=/de/", "#/fr/"]


def plain(url):
    host, path = parts(url)
    fits = [(len(r), len(r.partition("/")[0]), r, v) for r, v in URL_RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_against_brute_force(spark):
    urls = [f"{s}{h}{p}" for s in ("http://", "", "a://b://") for h in HOSTS for p in PATHS] + [None, ""]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    rows = {(r["page_id"], *r[1:]) for r in filter_urls(pages, URL_RULES).collect()}
    assert rows == {(i, *plain(u)) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, [], default="block").collect()} == {"block"}


def test_parts():
    assert parts("HTTP://Ä.Ex.ORG:80/A?b#c") == ("Ä.ex.org:80", "/A")
    assert parts("no scheme/x") == ("", "") and parts(None) == ("", "")


@settings(max_examples=30, deadline=None)
@given(st.sets(st.text(alphabet="ab./", min_size=1, max_size=6), max_size=40))
def test_collisions_are_confirmed_on_strings(tmp_path_factory, strings):
    rules = [(f"{s}/", "block") for s in strings]
    path = tmp_path_factory.mktemp("i") / "x.idx"
    path.write_bytes(build_index(rules))
    index = Index(str(path))
    stored = [index.string(i) for i in range(len(index.keys))]
    assert sorted(stored) == sorted(f"{s}/".encode() for s in strings)
    # With the right digests but other strings nothing is found; with both, every rule is.
    assert (index.find(np.array(index.keys), stored) == np.arange(len(stored))).all()
    assert (index.find(np.array(index.keys), [s + b"!" for s in stored]) == -1).all()


def test_equal_digests(tmp_path):
    path = tmp_path / "x.idx"
    data = bytearray(build_index([("a/", "allow"), ("b/", "block"), ("c/", "block")]))
    path.write_bytes(data)
    index = Index(str(path))
    same = np.full(3, 7, dtype=np.uint64)
    index.keys = same
    strings = [index.string(i) for i in range(3)]
    assert index.find(same, strings).tolist() == [0, 1, 2]


def test_long_hosts():
    """A host of very many labels costs no more than the rule of most labels."""
    host = "a." * 200_000 + "example.org"
    assert candidates(host, "/es/x", [1, 4], [1, 2]) == ["org/", "org/es/", "example.org/", "example.org/es/"]
    assert candidates("org", "/", [1], [1, 2, 5]) == ["org/"] and candidates("", "/", [1], [1]) == [] == candidates("org", "/", [], [])


def test_long_hosts_in_a_table(spark):
    pages = spark.createDataFrame([(1, "http://" + "b." * 100_000 + "x.com/de/"), (2, "http://" + "." * 1000 + "org/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, URL_RULES).collect()} == {1: ("com/de/", "block"), 2: ("org/", "allow")}
