"""Read models: immutable generations of rows behind an active pointer, and backups of an authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import id_order


def repeated_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rebuild(rows: DataFrame, path: str, generation: str, id_col: str = "id") -> None:
    """Write a generation and make it the active one. Repeated ids are refused before anything is written.

    The pointer is a table that names generations by number, so a reader sees the old or the new one, never a mixture.
    """
    if repeated_ids(rows, id_col).limit(1).count():
        raise ValueError("a read model has each row id once")
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{path}/generations/{generation}")
    number = 1 + max((r["number"] for r in _pointers(spark, path)), default=0)
    spark.createDataFrame([(generation, number)], "generation string, number long").coalesce(1).write.mode("errorifexists").parquet(f"{path}/pointer/turn={number}")


def _pointers(spark: SparkSession, path: str) -> list:
    """The last pointer. Each has a folder named by its number, so of two rebuilds at once one fails instead of both being the newest."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.parquet(f"{path}/pointer").agg(F.max("number").alias("number"), F.max_by("generation", "number").alias("generation")).collect()


def active(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/generations/{_pointers(spark, path)[0]['generation']}")


def page(spark: SparkSession, path: str, after: str | None, limit: int, id_col: str = "id") -> DataFrame:
    """Rows of the active generation after an id, in id order."""
    rows = active(spark, path)
    if after is not None:
        rows = rows.filter(id_order(F.col(id_col)) > id_order(F.lit(after)))
    return rows.orderBy(id_order(F.col(id_col))).limit(limit)


def retired(spark: SparkSession, path: str) -> list[str]:
    """Generations that have been active and no longer are; one that is being built has no pointer yet and isn't among them."""
    last = {r["generation"] for r in _pointers(spark, path)}
    return sorted({r["generation"] for r in spark.read.parquet(f"{path}/pointer").select("generation").distinct().collect()} - last) if last else []


def collect_retired(spark: SparkSession, path: str, most: int = 8) -> list[str]:
    """Delete at most so many retired generations, as readers of the one before may still be at work; returns their names."""
    found = []
    for name in retired(spark, path):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/generations/{name}")
        if len(found) < most and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True):
            found.append(name)
    return found


def storage(rows: DataFrame, payload: str, generation: str = "generation") -> DataFrame:
    """Rows and bytes (two a character) of each generation."""
    return rows.groupBy(generation).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(payload) * 2).cast("long").alias("n_bytes"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str], floor: int, epoch: str) -> dict[str, DataFrame]:
    """The tables of a backup; feeds go on at max(floor, their sequence) under a new epoch."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if "feeds" in found:
        found["feeds"] = found["feeds"].withColumn("head", F.greatest("head", F.lit(floor))).withColumn("epoch", F.lit(epoch))
    return found
