"""The set-based push against a step-by-step authority, over seeded random requests."""

import hashlib
import random

import pytest

from tidemark.operators import push

NOW = 1_800_000_000_000
OPS = "scope string, pos long, operation_id string, document_id string, base_version long, body_id string, updated_at string, payload string, `group` string, group_size int"
DOCS, RECEIPTS, FEEDS = "scope string, id string, version long, payload string", "operation_id string, fingerprint string, kind string, version long, error_code string", "scope string, head long, purged_through long"


def valid(i):
    return i is not None and 1 <= len(i.encode("utf-16-be")) // 2 <= 256 and all(ord(c) > 31 and not 127 <= ord(c) <= 159 for c in i)


def printed(o):
    text = lambda x: "" if x is None else str(x)
    whole = f"{len(o['document_id'].encode('utf-16-be')) // 2}:{o['document_id']}|{text(o['base_version'])}|{text(o['group'])}|{text(o['group_size'])}|{text(o['payload'])}"
    return hashlib.sha256(whole.encode()).hexdigest().upper()


class Authority:
    """One operation after the other, as the protocol tells it."""

    def __init__(self, docs, receipts, head, purged):
        self.docs, self.receipts, self.head, self.purged = dict(docs), dict(receipts), head, purged

    def malformed(self, o, seen):
        if not valid(o["operation_id"]) or not valid(o["document_id"]) or o["payload"] is None or o["body_id"] != o["document_id"] or (o["base_version"] is not None and o["base_version"] < 1):
            return True
        if o["document_id"] in seen:
            return True
        seen.add(o["document_id"])
        return False

    def replay(self, o):
        if o["operation_id"] in self.receipts:
            print_, kind, version, code = self.receipts[o["operation_id"]]
            return (kind, version, code, True) if print_ == printed(o) else ("rejected", None, "operation-id-reused", False)
        return None

    def evaluate(self, o):
        if int(o["updated_at"][:15]) > NOW + 300_000:
            return ("rejected", None, "clock-skew", False)
        current = self.docs.get(o["document_id"])
        if current is None and o["base_version"] is not None and o["base_version"] <= self.purged:
            return ("rejected", None, "base-expired", False)
        if current is not None and o["base_version"] != current:
            return ("conflict", current, None, False)
        return None

    def commit(self, o):
        self.head += 1
        self.docs[o["document_id"]] = self.head
        return ("accepted", self.head, None, False)

    def remember(self, o, out):
        if out[2] != "operation-id-reused":
            self.receipts[o["operation_id"]] = (printed(o), *out[:3])

    def push(self, ops):
        out, seen, groups = {}, set(), {}
        for o in ops:
            if o["group"] is not None:
                groups.setdefault(o["group"], []).append(o)
                continue
            if self.malformed(o, seen):
                out[o["pos"]] = ("rejected", None, "invalid", False)
                continue
            done = self.replay(o)
            if done is None:
                done = self.evaluate(o) or self.commit(o)
                self.remember(o, done)
            out[o["pos"]] = done
        for name, members in groups.items():
            bad = not valid(name) or any(o["group_size"] != len(members) for o in members)
            faults = [self.malformed(o, seen) for o in members]
            if bad or any(faults):
                out |= {o["pos"]: ("rejected", None, "invalid", False) for o in members}
                continue
            decided = [self.replay(o) or self.evaluate(o) for o in members]
            every = all(d is None or d[0] == "accepted" for d in decided)
            for o, d in zip(members, decided, strict=True):
                if d is not None:
                    if not d[3]:
                        self.remember(o, d)
                elif every:
                    d = self.commit(o)
                    self.remember(o, d)
                else:
                    d = ("retry-later", None, "group-aborted", False)
                out[o["pos"]] = d
        return out


def request(rng, authority):
    ops, ids = [], [f"d{i}" for i in range(40)]
    for pos in range(1, 61):
        i = rng.choice(ids)
        current = authority.docs.get(i)
        o = {
            "scope": "s", "pos": pos, "operation_id": rng.choice(["", "x\x01", f"op{rng.randrange(10**9)}", f"op{rng.randrange(10**9)}", f"op{rng.randrange(10**9)}"]), "document_id": rng.choice([i, i, i, i, ""]),
            "base_version": rng.choice([current, current, current, None, 1, 0, 10_000]), "updated_at": f"{NOW + rng.choice([0, 0, 0, 0, 300_001]):015d}:000000:n", "payload": rng.choice(["a", "b", "c", None]),
            "group": rng.choice([None, None, "g1", "g2", "g3", "g4", ""]), "group_size": 0,
        }
        o["body_id"] = rng.choice([o["document_id"]] * 9 + ["other"])
        ops.append(o)
    if rng.random() < 0.7:  # fewer faults, so that groups can succeed
        ops = [o for o in ops if o["operation_id"][:2] == "op" and o["document_id"] == o["body_id"] != "" and o["payload"] and o["base_version"] != 0]
        taken = set()
        ops = [o for o in ops if not (o["document_id"] in taken or taken.add(o["document_id"]))]
    for o in ops:
        if o["group"] is not None:
            o["group_size"] = sum(x["group"] == o["group"] for x in ops) + (rng.random() < 0.03)
    for o in rng.sample(ops, len(ops) // 5):  # resends, and ids used for something else
        kind = rng.choice(["accepted", "conflict", "rejected"])
        authority.receipts[o["operation_id"]] = (printed(o) if rng.random() < 0.6 else "other", kind, 7 if kind != "rejected" else None, "forbidden" if kind == "rejected" else None)
    singles = [o for o in ops if o["group"] is None]
    if len(singles) > 3:  # an id used twice in one request
        singles[-1]["operation_id"] = singles[0]["operation_id"]
    return ops


@pytest.mark.parametrize("seed", range(8))
def test_decisions_are_those_of_the_steps(spark, seed):
    rng = random.Random(seed)
    authority = Authority({f"d{i}": i + 1 for i in range(25)}, {}, 100, 30)
    ops = request(rng, authority)
    docs = spark.createDataFrame([("s", i, v, "p") for i, v in authority.docs.items()], DOCS)
    receipts = spark.createDataFrame([(k, *v[:1], v[1], v[2], v[3]) for k, v in authority.receipts.items() if k], RECEIPTS)
    feeds = spark.createDataFrame([("s", authority.head, authority.purged)], FEEDS)
    authority.receipts.pop("", None)
    order = OPS.replace("`", "").split(", ")
    df = spark.createDataFrame([tuple(o[c.split()[0]] for c in order) for o in ops], OPS)
    before = dict(authority.receipts)
    got_df = push.push(df, docs, receipts, feeds, NOW).cache()
    got = {r["pos"]: (r["kind"], r["version"], r["error_code"], r["duplicate"]) for r in got_df.collect()}
    assert got == authority.push(ops)
    fresh = {r["operation_id"]: (r["fingerprint"], r["kind"], r["version"], r["error_code"]) for r in push.new_receipts(got_df).collect()}
    assert {k: v for k, v in (before | fresh).items()} == authority.receipts


def test_a_resend_is_answered_from_its_receipt(spark):
    ops = spark.createDataFrame([("s", 1, "op1", "d1", None, "d1", f"{NOW:015d}:000000:n", "a", None, 0)], OPS)
    none_docs, none_receipts = spark.createDataFrame([], DOCS), spark.createDataFrame([], RECEIPTS)
    feeds = spark.createDataFrame([("s", 10, 0)], FEEDS)
    first = push.push(ops, none_docs, none_receipts, feeds, NOW)
    receipts = push.new_receipts(first)
    moved_on = spark.createDataFrame([("s", "d1", 55, "z")], DOCS)
    again = push.push(ops, moved_on, receipts, feeds, NOW).first()
    assert (again["kind"], again["version"], again["duplicate"]) == ("accepted", 11, True)
    assert push.committed(first).count() == 1 and push.new_receipts(push.push(ops, moved_on, receipts, feeds, NOW)).count() == 0


def test_groups_settle_by_their_own_columns(spark):
    """Decisions without operation ids or payloads; what has no group stays as it is."""
    rows = [("s", 1, "g", "accepted", False, None), ("s", 2, "g", "conflict", False, None), ("s", 3, "h", "accepted", False, None), ("s", 4, None, "accepted", False, None), ("s", None, None, "rejected", False, "invalid")]
    evaluated = spark.createDataFrame(rows, "scope string, pos long, `group` string, kind string, duplicate boolean, error_code string")
    got = push.settle_groups(evaluated)
    assert got.columns == evaluated.columns
    want = [("retry-later", "group-aborted"), ("conflict", None), ("accepted", None), ("accepted", None), ("rejected", "invalid")]
    assert sorted(map(str, ((r["kind"], r["error_code"]) for r in got.collect()))) == sorted(map(str, want))


def test_group_abort_over_odd_lines(spark, tmp_path):
    """Lines without order, number or flag, flags of other kinds, and lines that repeat, as the query's SQL has them."""
    import duckdb

    from tests.oracle import check
    from tidemark.plans.catalog import ORACLE_SQL, QUERIES

    flags = ["A", "AN", "AR", ["A", None], ["A", "N", None], [None, None], ["A", "X"], ["X", None], ["", "A", None], "NR", "AA"]
    rows = [(order, line, flag) for order, group in enumerate(flags) for line, flag in enumerate(group)]
    rows += [(None, 1, "A"), (None, 2, "N"), (None, 3, None), (20, None, "A"), (20, 1, "A"), (21, None, None), (21, 1, "R"), (10, 0, "R"), (10, 0, "A"), (22, 1, None), (22, 1, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    check(QUERIES["push_group_abort"](spark, str(tmp_path)), con, ORACLE_SQL["push_group_abort"])
