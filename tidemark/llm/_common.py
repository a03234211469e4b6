"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import hashlib
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the word-based operators define it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or, under a local master alone, a temporary one where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not getattr(spark, "_tidemark_shared", None):
        spark._tidemark_shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, spark._tidemark_shared, ignore_errors=True)
    return f"file://{spark._tidemark_shared}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a file to the shared folder, whatever store that is; its URI."""
    target = f"{shared_dir(spark)}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(content), 1 << 20):
        out.write(bytearray(content[i : i + (1 << 20)]))
    out.close()
    return target if urlparse(target).scheme else f"file://{target}"


def ship(spark: SparkSession) -> None:
    """Give this package to all Python workers, also those of executors that join later; once a session."""
    if getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    content = data.getvalue()
    spark.sparkContext.addPyFile(put_shared(spark, f"tidemark-{hashlib.sha256(content).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip", content))
    spark.sparkContext._tidemark_shipped = True


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInPandas by a function of this package."""
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it by name in body, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only after counting rows; df should be a stored table, whose count is cheap."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def numbered_copies(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(rows (id string, text, copy), bytes of all texts and 8 a row): rows that repeat an id with its text are told apart by a number from 0.

    The numbers follow from the rows alone, however these are split: digests that occur more than once are counted, their
    rows become one each with a count, and are repeated with numbers. All other rows pass as they are, without a shuffle.
    """
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("id", "text")
    counts = own.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("bytes"))
    counts = stored(counts, "row-counts")
    total = counts.agg(F.sum("bytes")).first()[0] or 0
    several = counts.filter("n > 1").select("key")
    once = own.withColumn("copy", F.lit(0).cast("long"))
    if several.limit(1).count() == 0:
        return once, total
    several = broadcast_if_small(several, 1_000_000)
    keyed = own.withColumn("key", key)
    repeated = keyed.join(several, "key", "left_semi").groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = repeated.select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return keyed.withColumn("copy", F.lit(0).cast("long")).join(several, "key", "left_anti").select("id", "text", "copy").unionByName(copies), total
