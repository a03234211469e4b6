"""Seeded schedules of edits and syncs on several replicas end with equal states, whatever the policy."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feed, merge, push, replica

DOCS = "scope string, id string, version long, payload string"
RECEIPTS = "operation_id string, fingerprint string, kind string, version long, error_code string"
OPS = "scope string, pos long, operation_id string, document_id string, base_version long, body_id string, updated_at string, payload string, `group` string, group_size int"


class World:
    """An authority and its replicas, kept as rows between the set-based steps."""

    def __init__(self, spark, policy):
        self.spark, self.policy, self.docs, self.receipts, self.head, self.stamp, self.sent, self.payloads = spark, policy, [], [], 0, 0, 0, {}
        self.replicas = [{"records": [], "since": 0} for _ in range(2)]

    def frame(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def rows(self, df, names):
        return [tuple(r) for r in df.select(*names).collect()]

    def records(self, r):
        return self.frame(r["records"], replica.RECORD)

    def keep(self, r, df):
        r["records"] = self.rows(df, replica.COLUMNS)

    def edit(self, r, rng):
        self.stamp += 1
        writes = []
        for i in rng.sample(range(6), 2):
            writes.append((f"doc{i}", f"{self.stamp:015d}:000000:n|{rng.randrange(99)}", False, None))
        self.keep(r, replica.write(self.records(r), self.frame(writes, "id string, document string, delete boolean, group_id string")))

    def pull(self, r):
        more = True
        while more:
            page = feed.pull_page(self.frame(self.docs, DOCS), r["since"], 3).collect()
            changes = self.frame([(x["id"], x["payload"], x["version"]) for x in page if x["id"] is not None], "id string, document string, version long")
            self.keep(r, replica.apply_remote(self.records(r), changes, 0))
            more, r["since"] = page[0]["has_more"], page[0]["checkpoint"]

    def push(self, r, lose_response=False):
        dirty = [dict(zip(replica.COLUMNS, x, strict=True)) for x in r["records"]]
        ready = []
        for d in dirty:
            if d["is_dirty"] and d["rejection"] is None:
                if d["pending_op"] is None:
                    self.sent += 1
                    d |= {"pending_op": f"op{self.sent}", "pending_revision": d["local_revision"]}
                    self.payloads[d["pending_op"]] = d["current"], d["base_version"]  # a resend asks for the same, whatever was edited since
                ready.append(d)
        if not ready:
            return False
        r["records"] = [tuple(d[c] for c in replica.COLUMNS) for d in dirty]
        asked = [(d, *self.payloads[d["pending_op"]]) for d in ready]
        ops = self.frame([("s", n, d["pending_op"], d["id"], base, d["id"], text[:24], text, None, 0) for n, (d, text, base) in enumerate(asked)], OPS)
        feeds = self.frame([("s", self.head, 0)], "scope string, head long, purged_through long")
        out = [x.asDict() for x in push.push(ops, self.frame(self.docs, DOCS), self.frame(self.receipts, RECEIPTS), feeds, 0).collect()]
        fresh = push.new_receipts(self.frame([tuple(x.values()) for x in out], "scope string, pos long, operation_id string, document_id string, kind string, version long, error_code string, duplicate boolean, fingerprint string, payload string, invalid boolean"))
        self.receipts += self.rows(fresh, [c.split()[0] for c in RECEIPTS.split(", ")])
        accepted = [("s", x["document_id"], x["version"], x["payload"]) for x in out if x["kind"] == "accepted" and not x["duplicate"]]
        self.head += len(accepted)
        names = [c.split()[0] for c in DOCS.split(", ")]
        self.docs = self.rows(feed.latest(self.frame(self.docs + accepted, DOCS), ["scope", "id"]), names)
        if lose_response:
            return True
        stored = {d[1]: (d[3], d[2]) for d in self.docs}
        acks = [(x["operation_id"], x["kind"], x["version"], x["payload"] if x["kind"] == "accepted" else None, x["error_code"]) for x in out if x["kind"] != "conflict"]
        self.keep(r, replica.acknowledge(self.records(r), self.frame(acks, "operation_id string, kind string, version long, document string, error_code string"), 0))
        conflicts = [(x["operation_id"], stored[x["document_id"]][0], stored[x["document_id"]][1], x["payload"], next(d["local_revision"] for d in ready if d["id"] == x["document_id"])) for x in out if x["kind"] == "conflict"]
        if conflicts:
            met = self.frame(conflicts, "operation_id string, server string, server_version long, fork string, revision long")
            stamp = lambda c: F.substring(c, 1, 24)
            outcome = {"server": F.lit("use-master"), "client": F.lit("keep-fork"), "last-write": merge.last_write_wins(stamp("fork"), stamp("server"))}[self.policy]
            decisions = met.withColumn("outcome", outcome).withColumn("resolved", F.lit(None).cast("string"))
            self.keep(r, replica.resolve(self.records(r), decisions, 0))
        return True


@pytest.mark.parametrize(("policy", "seed"), [("server", 1), ("client", 2), ("last-write", 3)])
def test_replicas_converge(spark, policy, seed):
    rng, world = random.Random(seed), World(spark, policy)
    for _ in range(5):
        r = rng.choice(world.replicas)
        world.edit(r, rng)
        if rng.random() < 0.7:
            world.pull(r)
            world.push(r, lose_response=rng.random() < 0.3)
    for _ in range(2):  # quiescence: nobody edits any more
        for r in world.replicas:
            for _ in range(5):
                world.pull(r)
                if not world.push(r):
                    break
    for r in world.replicas:
        world.pull(r)
    want = sorted((d[1], d[3], d[2]) for d in world.docs)
    for r in world.replicas:
        records = [dict(zip(replica.COLUMNS, x, strict=True)) for x in r["records"]]
        assert not any(x["is_dirty"] for x in records)
        assert sorted((x["id"], x["current"], x["base_version"]) for x in records) == want
    assert len({d[2] for d in world.docs}) == len(world.docs) and max(d[2] for d in world.docs) <= world.head
