"""Tables that cut a lineage: written to the folder that all machines share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: under spark.checkpoint.dir, or a temporary one under a local master where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tidemark-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return f"file://{folder}"
    return f"{shared.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: what reads it twice doesn't make it twice, and lost executors don't cost more than a read."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
