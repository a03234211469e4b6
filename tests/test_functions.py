import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import checkpoint, clock
from tidemark.functions.ids import id_order, id_valid
from tidemark.operators import clocks, merge
from tidemark.operators.numbering import number_rows, running_total
from tidemark.operators.queries import Range, page_after, select


@pytest.mark.parametrize("lot", [65_536, 7, 1])
def test_clock_fold_is_the_step_by_step_clock(spark, monkeypatch, lot):
    from tidemark.operators import numbering

    monkeypatch.setattr(numbering, "LOT", lot)
    rng = random.Random(2)
    events = []
    for node in range(5):
        wall = 1000
        for seq in range(60):
            wall += rng.choice((-3, 0, 0, 1, 5))
            remote = None if rng.random() < 0.5 else f"{wall + rng.randint(-5, 30):015d}:{rng.randrange(4):06d}:r"
            events.append((node, seq, wall, remote))
    df = spark.createDataFrame(events, "node long, seq long, physical long, remote string")
    got = {r["node"]: (r["wall"], r["counter"], r["refused"]) for r in clocks.update_clocks(df, "node", "seq", "physical", "remote", most_drift=20).collect()}
    for node in range(5):
        wall = counter = refused = 0
        for _, _, now, remote in (e for e in events if e[0] == node):
            w, c = (int(remote[:15]), int(remote[16:22])) if remote else (-1, 0)
            if remote and w - now > 20:
                refused += 1
                continue
            new = max(wall, w, now)
            counter = max(counter, c) + 1 if new == wall == w else counter + 1 if new == wall else c + 1 if new == w else 0
            wall = new
        assert got[node] == (wall, counter, refused)


def test_stamps_of_a_busy_node_over_lots(spark, monkeypatch):
    from tidemark.operators import numbering

    monkeypatch.setattr(numbering, "LOT", 16)
    rng, wall, rows = random.Random(8), 1000, []
    for seq in range(200):
        wall += rng.choice((-4, 0, 0, 2, 3))
        rows.append((rng.randrange(2), seq, wall))
    got = {r["seq"]: r["stamp"] for r in clocks.now_stamps(spark.createDataFrame(rows, "node long, seq long, physical long"), "node", "seq", "physical").collect()}
    state = {}
    for node, seq, now in rows:
        w, c = state.get(node, (0, 0))
        state[node] = (now, 0) if now > w else (w, c + 1)
        assert got[seq] == f"{state[node][0]:015d}:{state[node][1]:06d}:{node}"


def test_counter_carries_into_the_wall(spark):
    steps = spark.createDataFrame([(0, 0, 5, "000000000000005:999999:r")], "node long, seq long, physical long, remote string")
    r = clocks.update_clocks(steps, "node", "seq", "physical", "remote").first()
    assert (r["wall"], r["counter"]) == (6, 0)


def test_text_order_of_stamps_is_causal_order(spark):
    rows = [(w, c, n) for w in (0, 9, 10, 999_999_999_999_999) for c in (0, 9, 10, 999_999) for n in ("", "A", "a", "~")]
    df = spark.createDataFrame(rows, "w long, c long, n string").withColumn("s", clock.encode(F.col("w"), F.col("c"), F.col("n")))
    assert [(r["w"], r["c"], r["n"]) for r in df.orderBy("s").collect()] == sorted(rows)
    assert df.filter(~clock.valid(F.col("s"))).count() == 0


def test_ids(spark):
    rows = [("a", True), ("", False), (None, False), ("x" * 256, True), ("x" * 257, False), ("😀" * 128, True), ("😀" * 129, False), ("a\nb", False), ("a\x85", False), ("ノート-😀", True)]
    df = spark.createDataFrame(rows, "i string, ok boolean")
    assert df.filter(id_valid(F.col("i")) != F.col("ok")).count() == 0
    mixed = spark.createDataFrame([("😀",), ("￮",), ("a",)], "i string")
    assert [r["i"] for r in mixed.orderBy(id_order(F.col("i"))).collect()] == ["a", "😀", "￮"]


@pytest.mark.parametrize(("text", "reason"), [(None, None), ("x", "malformed"), ("e~h:05", "malformed"), ("e~h:-1", "malformed"), ("e:5", "epoch"), ("f~h:500", "epoch"), ("e~g:500", "scope-changed"), ("e~h:5", "expired"), ("e~h:0", None), ("e~h:100", None), ("a:b~h:500", "epoch")])
def test_checkpoints(spark, text, reason):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(checkpoint.reset_reason(F.col("c"), F.lit("e"), F.lit("h"), F.lit(100))).first()[0] == reason


CARD = T.StructType([T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("views", T.LongType()), T.StructField("address", T.StructType([T.StructField("street", T.StringType()), T.StructField("city~/x", T.StringType())]))])
BASE = ("t", ["a", "b"], 10, ("s", "c"))


@pytest.mark.parametrize(("local", "server", "flags", "content", "conflicts", "deleted", "same"), [
    (("t2", ["a", "b"], 10, ("s", "c")), ("t", ["a", "b"], 10, ("s2", "c")), (0, 0, 0), ("t2", ["a", "b"], 10, ("s2", "c")), [], False, False),
    (("t2", ["a", "b"], 10, ("s", "c")), ("t3", ["a", "b"], 10, ("s", "c")), (0, 0, 0), ("t3", ["a", "b"], 10, ("s", "c")), ["/title"], False, True),
    (("t2", ["a", "b"], 10, ("s", "c")), ("t2", ["a", "b"], 10, ("s", "c")), (0, 0, 0), ("t2", ["a", "b"], 10, ("s", "c")), [], False, True),
    (("t", ["b", "l", None], 12, ("s", "c")), ("t", ["v", "a", "b", "v"], 15, ("s", "c")), (0, 0, 0), ("t", ["v", "b", "l", None], 17, ("s", "c")), [], False, False),
    (("t", None, None, ("s", "c")), ("t", ["a", "b", "n"], 11, ("s", "c")), (0, 0, 0), ("t", ["n"], 1, ("s", "c")), [], False, False),
    (("t", ["a", "b"], 10, ("s", "c1")), ("t", ["a", "b"], 10, ("s1", "c2")), (0, 0, 0), ("t", ["a", "b"], 10, ("s1", "c2")), ["/address/city~0~1x"], False, True),
    (("t", ["a", "b"], 10, None), ("t", ["a", "b"], 10, ("s1", "c2")), (0, 0, 0), ("t", ["a", "b"], 10, ("s1", "c2")), ["/address"], False, True),
    (BASE, ("t", ["a", "b"], 10, ("s", "c")), (0, 1, 0), BASE, [], True, False),
    (BASE, ("t2", ["a", "b"], 10, ("s", "c")), (0, 1, 0), ("t2", ["a", "b"], 10, ("s", "c")), ["(deleted)"], False, True),
    (("t2", ["a", "b"], 10, ("s", "c")), BASE, (0, 0, 1), ("t2", ["a", "b"], 10, ("s", "c")), ["(deleted)"], True, True),
    (BASE, BASE, (1, 0, 1), BASE, [], False, False),
    (("t2", ["a", "b"], 10, ("s", "c")), ("t3", ["a", "b"], 10, ("s", "c")), (0, 1, 1), ("t3", ["a", "b"], 10, ("s", "c")), [], True, True),
])
def test_three_way_merge(spark, local, server, flags, content, conflicts, deleted, same):
    rows = T.StructType([T.StructField(n, CARD) for n in ("b", "l", "s")])
    df = spark.createDataFrame([(BASE, local, server)], rows)
    out = merge.three_way(CARD, F.col("b"), F.col("l"), F.col("s"), *(F.lit(bool(f)) for f in flags), sets={"/tags"}, counters={"/views"})
    r = df.select(*(v.alias(k) for k, v in out.items())).first()
    got = (r["content"]["title"], r["content"]["tags"], r["content"]["views"], tuple(r["content"]["address"]))
    assert (got, r["conflicts"], r["deleted"], r["same_as_server"], r["clean"]) == (content, conflicts, deleted, same, not conflicts)


def test_numbers_without_gaps_over_lots(spark):
    rng = random.Random(4)
    rows = [(g, v, rng.randrange(9)) for g in "ab" for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v long, x long")
    lot = F.floor(F.col("v") / 100)
    got = {(r["g"], r["v"]): (r["number"], r["total"]) for r in running_total(number_rows(df, ["g"], ["v"], lot), ["g"], ["v"], lot, F.col("x"), "total").collect()}
    for g in "ab":
        own = sorted((v, x) for h, v, x in rows if h == g)
        total = 0
        for i, (v, x) in enumerate(own, 1):
            total += x
            assert got[g, v] == (i, total)


@pytest.mark.parametrize("descending", [False, True])
def test_keyset_pages_walk_the_whole_index(spark, descending):
    rng = random.Random(5)
    rows = [(f"i{k}", rng.choice((None, 1, 2, 2, 3)), False) for k in range(40)] + [("😀", 2, False), ("￮", 2, False)]
    df = spark.createDataFrame(rows, "id string, key long, deleted boolean").cache()
    index = Range("key", descending=descending)
    order = lambda r: (r[1] is not None, r[1] or 0, r[0].encode("utf-16-be"))
    want = [r[0] for r in sorted(rows, key=order, reverse=descending)]
    page, got = select(df, index=index, limit=7).collect(), []
    while page:
        got += [r["id"] for r in page]
        page = page_after(df, index, page[-1]["key"], page[-1]["id"], 7).collect()
    assert got == want
    for bad in ({"limit": 0}, {"limit": 1001}, {"skip": -1}, {"index": index, "order": []}):
        with pytest.raises(ValueError):
            select(df, **bad)
