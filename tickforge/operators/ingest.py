"""Idempotent ingest: the first write of a minute wins, whatever is replayed.

A batch reads only the stored months, and of these the row groups, that lie within its times, so its cost doesn't follow the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.candles import STORED, as_stored
from ..sources.scratch import is_whole, once, stored
from . import tables
from .joins import with_small

KEY = ["symbol", "__minute"]


def create_if_absent(spark: SparkSession, table: str, schema=STORED, path: str | None = None) -> None:
    """A stored table in the warehouse or at path. Uniqueness is kept by append_new, with one writer a table."""
    tables.create(spark, table, schema, path)


def reset(spark: SparkSession, table: str) -> None:
    """Empties the table; only ever called by name."""
    create_if_absent(spark, table)
    spark.createDataFrame([], spark.table(table).schema).write.insertInto(table, overwrite=True)


def first_of_minute(batch: DataFrame, arrival: list[str]) -> DataFrame:
    """Of the rows of a symbol and minute, the one that arrived first."""
    w = Window.partitionBy(*KEY).orderBy(*arrival)
    return (
        batch.withColumn("__minute", S.floor_minute(F.col("open_time_ms")))
        .withColumn("__rank", F.row_number().over(w))
        .where("__rank = 1")
        .drop("__rank")
    )


def insert_or_ignore(old: DataFrame, batch: DataFrame, arrival: list[str]) -> DataFrame:
    """The rows of batch that violate no key of old nor of each other. A null key is never new."""
    new = first_of_minute(batch.where(F.col("symbol").isNotNull() & F.col("open_time_ms").isNotNull()), arrival)
    keys = old.select("symbol", S.floor_minute(F.col("open_time_ms")).alias("__minute"))
    return new.join(keys, KEY, "left_anti").drop("__minute")


def touched(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored rows that may share a minute with one of rows (with open_time_ms and open_date)."""
    return tables.within(table, [(m, a - a % S.MINUTE_MS, z - z % S.MINUTE_MS + S.MINUTE_MS - 1) for m, a, z in tables.bounds(rows)])


def append_new(table: str, batch: DataFrame, arrival: list[str]) -> DataFrame:
    """Appends the batch's new minutes to the stored table and gives them back, with their arrival. A replayed batch adds nothing. The batch is
    read twice, first for its bounds: give a written one where it is dear to make."""
    rows = as_stored(batch, *arrival)
    new = stored(insert_or_ignore(touched(batch.sparkSession.table(table), rows), rows, arrival), "new-candles")
    tables.append(new, table)
    return new


def append_once(table: str, rows: DataFrame, arrival: list[str], path: str, strict: bool = False) -> DataFrame:
    """append_new of a stream's batch (as_stored, written). What is new is settled once and written to path before anything is appended, so
    a try that broke off while appending changes neither the result nor, in strict mode, the marks that rows are held against."""
    spark = rows.sparkSession
    again = is_whole(spark, path)
    wanted = beyond_mark(spark.table(table), rows) if strict and not again else rows
    new = once(insert_or_ignore(touched(spark.table(table), rows), wanted, arrival), path)
    tables.append(insert_or_ignore(touched(spark.table(table), new), new, arrival) if again else new, table)
    return new


def beyond_mark(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (as_stored) that are newer than all that the table has of their symbol. Only months from the first of rows on can hold
    one that isn't older."""
    spans = tables.bounds(rows)
    if not spans:
        return rows
    marks = table.where(F.col("open_month") >= min(m for m, _, _ in spans)).groupBy("symbol").agg(F.max("open_time_ms").alias("__mark"))
    return with_small(rows, stored(marks, "marks"), "symbol").where("__mark IS NULL OR open_time_ms > __mark").drop("__mark")


def sync_report(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per symbol of the batch: rows attempted, inserted and ignored, first and last minute."""
    came = batch.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("attempted"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")
    )
    went = inserted.groupBy("symbol").agg(F.count(F.lit(1)).alias("inserted"))
    return came.join(went, "symbol", "left").select(
        "symbol", "attempted", F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.col("attempted") - F.coalesce("inserted", F.lit(0))).alias("ignored"), "first_time", "last_time",
    )


def high_water_mark(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol").agg(F.max("open_time_ms").alias("high_water_ms"))


def sync_bounds(marks: DataFrame, now_ms: int) -> DataFrame:
    """[start_ms, end_ms) for each symbol's next fetch, and whether there is nothing to fetch."""
    end = F.lit(now_ms - now_ms % S.MINUTE_MS)
    start = S.sync_start(F.col("high_water_ms"))
    return marks.select(
        "symbol", "high_water_ms", start.alias("start_ms"), end.alias("end_ms"), (start >= end).cast("int").alias("is_empty")
    )


def fetch(landing: DataFrame, bounds: DataFrame) -> DataFrame:
    """Of a landing table's rows, those of each symbol's own [start_ms, end_ms) (sync_bounds): a range join to a table of a row a symbol, broadcast
    after a count. Symbols with an empty range get nothing. Months before the least start, and row groups outside of all ranges, aren't read."""
    wanted = stored(bounds.where("is_empty = 0").select("symbol", "start_ms", "end_ms"), "wanted")
    least, most = wanted.agg(F.min("start_ms"), F.max("end_ms")).first()
    if least is None:
        return landing.where("false")
    rows = landing.where((F.col("open_time_ms") >= least) & (F.col("open_time_ms") < most))
    if "open_month" in landing.columns:
        rows = rows.where(F.col("open_month").between(*(S.local_month(ms) for ms in (least, most))))
    found = with_small(rows, wanted, "symbol").where("open_time_ms >= start_ms AND open_time_ms < end_ms")
    return found.drop("start_ms", "end_ms")
