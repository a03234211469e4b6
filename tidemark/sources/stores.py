"""Stores of documents as tables: JSON files, SQL authorities by JDBC, flat exported records, blob files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import wire
from tidemark.operators import replica

#: Columns of every document; what an application adds comes after.
DOCUMENT = "id STRING, updated_at STRING, deleted BOOLEAN"


def json_documents(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Documents from JSON lines with a declared schema; members it doesn't name are kept in `_unknown`, in JSON text.

    The schema is never inferred: a collection has one type, and old readers must carry what newer writers add.
    """
    known = T._parse_datatype_string(f"{DOCUMENT}, {fields}")
    raw = spark.read.text(path)
    members = F.from_json("value", "map<string,string>")
    rest = F.map_filter(members, lambda k, _: ~k.isin([f.name for f in known.fields]))
    return raw.select(F.from_json("value", known).alias("d"), rest.alias("_unknown")).select("d.*", "_unknown")


def to_json_documents(docs: DataFrame) -> DataFrame:
    """The reverse of json_documents: one column `value`, with the unknown members as they were."""
    own = [c for c in docs.columns if c != "_unknown"]
    if "_unknown" not in docs.columns:
        return docs.select(F.to_json(F.struct(*own)).alias("value"))
    literal = r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|\[.*\]|\{.*\})$"
    name = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r"^\{.k.:(.*)\}$", 1)  # noqa: E731  # JSON text of a string
    member = lambda e: F.concat(name(e["key"]), F.lit(":"), F.when(e["value"].rlike(literal), e["value"]).otherwise(F.coalesce(name(e["value"]), F.lit("null"))))
    extra = F.array_join(F.transform(F.map_entries("_unknown"), member), ",")
    body = F.regexp_replace(F.to_json(F.struct(*own)), r"\}$", "")
    return docs.select(F.concat(body, F.when(F.size("_unknown") > 0, F.concat(F.lit(","), extra)).otherwise(F.lit("")), F.lit("}")).alias("value"))


def jdbc_authority(spark: SparkSession, url: str, schema: str, partitions: int = 32, **options: str) -> dict[str, DataFrame]:
    """documents, receipts, feeds and access of an SQL authority; documents are read in ranges of their versions."""

    def read(table: str, split: bool) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{table}", **options)
        if split:
            top = spark.read.format("jdbc").options(url=url, query=f"SELECT max(version) AS v FROM {schema}.{table}", **options).load().first()[0]
            reader = reader.options(partitionColumn="version", lowerBound="0", upperBound=str(top or 1), numPartitions=str(partitions))
        return reader.load()

    return {"documents": read("documents", True), "receipts": read("receipts", False), "feeds": read("feeds", False), "access": read("document_access", True)}


def flat_records(rows: DataFrame) -> DataFrame:
    """Exported records of a browser store, whose 64-bit numbers are text, as replica records."""
    types = {c.split()[0]: c.split()[1] for c in replica.RECORD.split(", ")}
    have = set(rows.columns)
    cast = lambda c, t: wire.int64(F.col(c).cast("string")) if t == "BIGINT" else F.col(c).cast(t)
    return rows.select(*((cast(c, t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()))


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as blobs: id (file name), content, size, sha256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("id"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_feed(docs: DataFrame, path: str, scope: str = "scope", version: str = "version") -> None:
    """A feed laid out for pulling: a folder a scope, within files in version order, so a page reads few row groups."""
    docs.repartitionByRange(F.col(scope), F.col(version)).sortWithinPartitions(scope, version).write.partitionBy(scope).parquet(path)


def _cursors(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/cursors")
    return hadoop, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_records(records: DataFrame, cursor: tuple[str, int], path: str) -> int:
    """Store all records and the replica's cursor (checkpoint, generation) as one step; returns its number.

    Records go to a folder of a fresh name, which the cursor names. The cursor is one small file that is created last and never
    overwritten: a step without one never happened, and of two writers of one step the second gets an error and leaves nothing
    that is read. That holds as far as the store creates files exclusively, as HDFS does.
    """
    spark = records.sparkSession
    done = stored_records(spark, path)
    number = 1 if done is None else done[2] + 1
    folder = f"records/{uuid.uuid4().hex}"
    records.write.parquet(f"{path}/{folder}")
    hadoop, cursors, fs = _cursors(spark, path)
    target = hadoop.Path(cursors, f"step={number:012d}.json")
    out = fs.create(target, False)
    out.write(bytearray(json.dumps({"checkpoint": cursor[0], "generation": cursor[1], "records": folder}).encode()))
    out.close()
    return number


def stored_records(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, int], int] | None:
    """(records, cursor, number) of the last whole step, if there is any."""
    _, folder, fs = _cursors(spark, path)
    steps = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    for name in reversed(steps):
        row = spark.read.schema("checkpoint string, generation long, records string").json(f"{path}/cursors/{name}").first()
        if row is not None and row["records"] is not None:  # a writer that died while creating it left an empty file
            return spark.read.parquet(f"{path}/{row['records']}"), (row["checkpoint"], row["generation"]), int(name[5:17])
    return None
