"""Stores of devices: SQLite files that replicas keep, read and written by the fleet.

A file is one device's whole store and is opened in memory by the task that holds its bytes, so files may lie in any store
that Spark reads, and work and memory follow the files that a task has. Tables and columns are those of the format; columns that an older
schema lacks are null. A file is read if its schema is known and its pages are sound, or not at all; `device_states` says
which. A file in write-ahead mode is read as of its last checkpoint.

Writing deals a collection's records into stores of bounded size, so a collection that holds most rows is many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replica

# The format's schema number, tables and columns.
SCHEMA = 5
RECORDS = (
    "collection TEXT NOT NULL, id TEXT NOT NULL, id_key BLOB NOT NULL, current TEXT NOT NULL, updated_at TEXT NOT NULL, deleted INTEGER NOT NULL, base TEXT, base_version INTEGER, "
    "is_dirty INTEGER NOT NULL, local_revision INTEGER NOT NULL, pending_id TEXT, pending_revision INTEGER, pending_base_version INTEGER, pending_payload TEXT, rejection_revision INTEGER, "
    "rejection_code TEXT, rejection_message TEXT, observed TEXT, observed_version INTEGER, generation INTEGER NOT NULL, missing INTEGER NOT NULL, conflict_server TEXT, "
    "conflict_server_version INTEGER, conflict_local TEXT, conflict_base TEXT, group_id TEXT, group_members TEXT, pending_group TEXT, pending_group_size INTEGER, base_same INTEGER NOT NULL DEFAULT 0, rejection_arguments TEXT"
)
TABLES = {
    "bs_meta": "collection TEXT NOT NULL, key TEXT NOT NULL, value TEXT NOT NULL, PRIMARY KEY (collection, key)",
    "bs_records": f"{RECORDS}, PRIMARY KEY (collection, id)",
    "bs_index": "collection TEXT NOT NULL, name TEXT NOT NULL, key BLOB NOT NULL, id_key BLOB NOT NULL, PRIMARY KEY (collection, name, key, id_key)",
}
#: Of a replica record's columns, those that the format calls otherwise.
NAMES = {"pending_op": "pending_id", "rejection": "rejection_code", "conflict": "conflict_local", "conflict_version": "conflict_server_version"}


def device_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder; Spark doesn't list those without a byte."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _reading(kind: str, fields: list[tuple[str, str]], newest: int):
    """A function over Arrow batches of (path, content). All that it needs is inside it, so workers don't need this package."""
    names = dict(NAMES)

    def rows(batches):
        import sqlite3

        import pyarrow as pa

        types = {"STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_()}
        schema = pa.schema([(n, types[t]) for n, t in fields])

        def opened(content):
            """(connection, schema) of a file, or (None, state)."""
            con = sqlite3.connect(":memory:")
            try:
                if content is None or content[:16] != b"SQLite format 3\0":
                    return None, "unreadable"
                if content[18:20] != b"\1\1":  # as a file in memory has no log beside it
                    content = content[:18] + b"\1\1" + content[20:]
                con.deserialize(content)
                number = con.execute("PRAGMA user_version").fetchone()[0]
                if number > newest:
                    return None, "newer"
                if con.execute("PRAGMA quick_check(1)").fetchone()[0] != "ok":
                    return None, "unreadable"
                tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                return (con, number) if "bs_records" in tables else (None, "unreadable")
            except sqlite3.Error:
                return None, "unreadable"

        def found(con):
            have = {t: {r[1] for r in con.execute(f"PRAGMA table_info({t})")} for t in ("bs_records", "bs_index")}
            if kind == "index":
                return con.execute("SELECT collection, name, key, id_key FROM bs_index") if have["bs_index"] else []
            column = lambda c: c if c in have["bs_records"] else "NULL"
            base = f"CASE WHEN {column('base_same')} = 1 THEN current ELSE base END"
            return con.execute(f"SELECT {', '.join(base if n == 'base' else column(names.get(n, n)) for n, _ in fields[1:])} FROM bs_records")

        def made(path, con, state):
            if kind == "state":
                number, collections, n = (state, *con.execute("SELECT count(DISTINCT collection), count(*) FROM bs_records").fetchone()) if con else (None, None, None)
                yield path, "ok" if con else state, number, collections, n
            elif con and kind == "index":
                for collection, name, key, i in found(con):
                    yield path, collection, name, key.decode("utf-16-be", "surrogatepass"), i.decode("utf-16-be", "surrogatepass")
            elif con:
                flags = [i for i, (_, t) in enumerate(fields[1:]) if t == "BOOLEAN"]
                for r in found(con):
                    r = list(r)
                    for i in flags:
                        r[i] = None if r[i] is None else bool(r[i])
                    yield path, *r

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                con, state = opened(batch.column("content")[i].as_py())
                part, held = [], 0
                for r in made(batch.column("path")[i].as_py(), con, state):
                    part.append(r)
                    held += sum(len(v) for v in r if isinstance(v, str))
                    if held > 4_000_000 or len(part) == 10_000:
                        yield batch_of(part)
                        part, held = [], 0
                if part:
                    yield batch_of(part)
                if con:
                    con.close()

    return rows


def _read(files: DataFrame, kind: str, fields: str) -> DataFrame:
    listed = [(f.split()[0], f.split()[1]) for f in fields.split(", ")]
    return files.select("path", "content").mapInArrow(_reading(kind, listed, SCHEMA), fields)


def device_records(files: DataFrame) -> DataFrame:
    """Replica records of all stores (path, content), with path, collection, updated_at and deleted."""
    return _read(files, "records", f"path STRING, collection STRING, updated_at STRING, deleted BOOLEAN, {replica.RECORD}")


def device_indexes(files: DataFrame) -> DataFrame:
    """Index entries of all stores: path, collection, index, key and id, as `operators.queries.index_entries` makes them."""
    return _read(files, "index", "path STRING, collection STRING, index STRING, key STRING, id STRING")


def device_states(files: DataFrame) -> DataFrame:
    """Of each file whether it was read (ok, newer, unreadable), its schema, collections and records."""
    return _read(files, "state", "path STRING, state STRING, schema BIGINT, collections BIGINT, n BIGINT")


def to_device_stores(records: DataFrame, by: str, collection: str, rows_a_store: int = 100_000) -> DataFrame:
    """(by, part, content, n): the records as SQLite stores. by: the column that names a device; collection: that of the collection.

    A device with more records than a store may hold gets several (part, by a hash of the ids). updated_at and deleted are taken where
    records have them. Indexes aren't written: a client builds those that it declares.
    """
    have = set(records.columns)
    parts = records.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / rows_a_store).alias("_parts"))
    own = ["updated_at", "deleted", *replica.COLUMNS]
    default = {"updated_at": F.lit(""), "deleted": F.lit(False)}
    dealt = records.join(parts, F.col(by).eqNullSafe(F.col("_by"))).select(
        F.col(by).cast("string").alias("_device"), F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"), F.col(collection).cast("string").alias("_collection"), *(F.col(c) if c in have else default[c].alias(c) for c in own)
    )
    names, tables, number, columns = dict(NAMES), dict(TABLES), SCHEMA, [c.split()[0] for c in RECORDS.split(", ")]

    def built(table):
        import sqlite3

        import pyarrow as pa

        con = sqlite3.connect(":memory:")
        for name, body in tables.items():
            con.execute(f"CREATE TABLE {name} ({body})")
        con.execute(f"PRAGMA user_version = {number}")

        def row(r):
            same = r["base"] is not None and r["base"] == r["current"] and not r["is_dirty"]
            out = {names.get(c, c): r[c] for c in own}
            out |= {"collection": r["_collection"] or "", "id_key": r["id"].encode("utf-16-be", "surrogatepass"), "base": None if same else r["base"], "base_same": int(same)}
            if r["pending_op"] is not None:
                out |= {"pending_base_version": r["base_version"], "pending_payload": r["current"]}
            if r["rejection"] is not None:
                out |= {"rejection_revision": r["local_revision"]}
            if r["conflict"] is not None:
                out |= {"conflict_server": r["base"] if r["base"] is not None else r["current"], "conflict_base": r["base"]}
            if r["group_id"] is not None:
                out |= {"group_members": "[]"}
            return [out.get(c) for c in columns]

        for batch in table.to_batches(max_chunksize=10_000):
            con.executemany(f"INSERT INTO bs_records ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", map(row, batch.to_pylist()))
        con.commit()
        first = table.slice(0, 1).to_pylist()[0]
        kinds = pa.schema([("device", pa.string()), ("part", pa.int64()), ("content", pa.binary()), ("n", pa.int64())])
        return pa.table([[first["_device"]], [first["_part"]], [con.serialize()], [table.num_rows]], schema=kinds)

    return dealt.groupBy("_device", "_part").applyInArrow(built, "device STRING, part BIGINT, content BINARY, n BIGINT")
