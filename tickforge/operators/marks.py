"""What is known of each symbol of a stored table, kept up as batches come: its newest time and its number of rows.

A version is a folder under a number, made of the version before and the batch's new rows, so writing it again gives the same. Readers take the
newest whole one. A row a symbol is read and written, whatever the history.

Defined cases: a batch without new rows makes a version like the one before; an empty table has no versions, and no rows are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import exists, is_whole, remove, stored, subfolders
from . import tables
from .latest import newest_per_symbol

MARKS = "symbol string, high_water_ms long, n_rows long"
PREFIX = "version="


def _versions(spark: SparkSession, folder: str) -> list[int]:
    if not exists(spark, folder):
        return []
    return sorted(int(v.removeprefix(PREFIX)) for v in subfolders(spark, folder, PREFIX))


def kept_marks(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(symbol, high_water_ms, n_rows) of the newest whole version, or of the newest below a number."""
    for v in reversed(_versions(spark, folder)):
        if (before is None or v < before) and is_whole(spark, f"{folder}/{PREFIX}{v}"):
            return spark.read.schema(MARKS).parquet(f"{folder}/{PREFIX}{v}")
    return spark.createDataFrame([], MARKS)


def advance(folder: str, number: int, new: DataFrame) -> None:
    """Writes the version of a batch: `new` are the rows that it added. Versions before the last two are deleted."""
    spark = new.sparkSession
    more = new.groupBy("symbol").agg(F.max("open_time_ms").alias("high_water_ms"), F.count(F.lit(1)).alias("n_rows"))
    both = kept_marks(spark, folder, number).unionByName(more)
    both = both.groupBy("symbol").agg(F.max("high_water_ms").alias("high_water_ms"), F.sum("n_rows").alias("n_rows"))
    both.write.mode("overwrite").parquet(f"{folder}/{PREFIX}{number}")
    for v in _versions(spark, folder):
        if v < number - 1:
            remove(spark, f"{folder}/{PREFIX}{v}")


def newest_stored(spark: SparkSession, table: str, marks: DataFrame, n: int = 5) -> DataFrame:
    """The n newest rows of every symbol that has marks, with `place`. Months are read from the newest on, twice as many each time, and only for symbols
    that still have too few rows."""
    months = sorted({r[0].rpartition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}, reverse=True)
    wanted = stored(marks.select("symbol", F.least("n_rows", F.lit(n)).alias("__wanted")), "wanted")
    found, step = [], 1
    while months:
        rows = spark.table(table).where(F.col("open_month") >= months[min(step, len(months)) - 1])
        buckets = [r[0] for r in wanted.select(tables.bucket_of(F.col("symbol"), tables.buckets_of(spark, table))).distinct().collect()]
        top = newest_per_symbol(rows.where(F.col("bucket").isin(buckets)).join(wanted, "symbol"), n)
        top = stored(top.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))), "newest")
        last = step >= len(months)
        enough = F.lit(True) if last else F.col("__n") >= F.col("__wanted")
        found.append(top.where(enough).drop("__n", "__wanted"))
        if last:
            break
        wanted = stored(wanted.join(top.where(enough).select("symbol").distinct(), "symbol", "left_anti"), "wanted")
        if wanted.isEmpty():
            break
        step *= 2
    if not found:
        return newest_per_symbol(spark.table(table), n)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
