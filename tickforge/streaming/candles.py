"""Streaming ingest and scoring. Micro-batches go through the same operators as batches do.

A micro-batch is written once, under its number in the folder of the query's checkpoint; all else reads what was written, and a
replay reads it again. It reads the stored rows of its own times and, to score, as many days before them as the indicators look
back, so its cost doesn't follow the history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import LOCAL_OFFSET_MS
from ..operators import tables
from ..operators.indicators import DEFAULT_SPEC, FAST, SIGNAL, SLOW, Indicator, features, rows_before, span
from ..operators.ingest import append_once, create_if_absent, sync_report
from ..operators.joins import with_small
from ..operators.marks import advance
from ..operators.model import FROZEN, score
from ..sources.candles import as_stored
from ..sources.scratch import exists, is_whole, once, remove, stored
from .features import carried

SCORES = T.StructType(
    [
        T.StructField("open_time_ms", T.LongType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("predicted_proba_spike", T.DoubleType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("open_date", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("open_month", T.StringType()),
    ]
)
MINUTES_A_DAY = 1440
#: Rows of a landed file, and the most files of a part.
LANDED, LANDED_FILES = 50_000, 1_000
#: Symbols that are named in a partition filter; more are joined.
NAMED_SYMBOLS = 1000


def _started(candles: DataFrame, write, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = candles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_batch(
    batch: DataFrame, number: int, table: str, folder: str, arrival: list[str], strict: bool = False, report: str | None = None, marks: str | None = None
) -> DataFrame | None:
    """Appends a micro-batch's new minutes to the table and gives them back; none if it has no rows. folder: where the batch is kept under its number.
    batch may have a column `reject` (judged()): rows with one are kept out of the table. report: a folder that gets, at most once a batch, its
    rejects and a row for each symbol. marks: a folder whose marks (operators/marks.py) are advanced."""
    spark, path = batch.sparkSession, f"{folder}/batch-{number}"
    rows = as_stored(batch if "reject" in batch.columns else batch.withColumn("reject", F.lit(None).cast("string")), *arrival, "reject")
    if is_whole(spark, path):
        rows = once(rows, path)
        empty = rows.isEmpty()
    else:
        told = Observation()
        rows = once(rows.observe(told, F.count(F.lit(1)).alias("n")), path)
        empty = not told.get["n"]
    old = f"{folder}/batch-{number - 2}"
    if exists(spark, old):
        remove(spark, old)
    if empty:
        return None
    good = rows.where("reject IS NULL").drop("reject")
    new = append_once(table, good, arrival, f"{path}-new", strict)
    if exists(spark, f"{old}-new"):
        remove(spark, f"{old}-new")
    if marks:
        advance(marks, number, new)
    if report:
        bad = rows.where("reject IS NOT NULL")
        counts = bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("rejected"))
        told = sync_report(good, new).join(counts.withColumnRenamed("symbol", "__s"), F.col("symbol").eqNullSafe(F.col("__s")), "full")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("attempted", "inserted", "ignored", "rejected")}
        told = told.withColumns(zero | {"symbol": F.coalesce("symbol", "__s")}).drop("__s")
        told.coalesce(1).write.mode("overwrite").parquet(f"{report}/symbols/batch={number}")
        bad.write.mode("overwrite").parquet(f"{report}/rejects/batch={number}")
    return new


def start_ingest(
    candles: DataFrame, table: str, checkpoint: str, arrival: list[str], every: str | None = None, strict: bool = False, report: str | None = None,
    marks: str | None = None,
) -> StreamingQuery:
    """Appends the new minutes of a stream of candles, normalised or judged, to the stored table, whose one writer is this query. A replayed
    batch adds nothing. every: the trigger's interval; none: what is there, then stop. strict: leave gaps behind the high-water mark
    as they are. report, marks: see ingest_batch; read them by batch_report(), rejects() and kept_marks()."""
    create_if_absent(candles.sparkSession, table)

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, number, table, f"{checkpoint}/candles", arrival, strict, report, marks)

    return _started(candles, write, checkpoint, every)


def batch_report(spark: SparkSession, report: str) -> DataFrame:
    """(batch, symbol, attempted, inserted, ignored, rejected, first_time, last_time) of all micro-batches; rejects without a symbol have null."""
    kinds = "symbol string, attempted long, inserted long, ignored long, first_time string, last_time string, rejected long, batch long"
    return spark.read.schema(kinds).parquet(f"{report}/symbols")


def rejects(spark: SparkSession, report: str) -> DataFrame:
    """The rows that were left out, with the batch and the reason."""
    return spark.read.option("basePath", f"{report}/rejects").parquet(f"{report}/rejects")


def recent_rows(history: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """The history's rows of the symbols of first (symbol, __first), back to n rows or more before that time, or to the symbol's first
    row. Whole days are read, four times as many while some symbol has too few rows in them and has older ones."""
    start = first.agg(F.min("__first")).first()[0]
    if start is None:
        return history.where("false")
    day = datetime.fromtimestamp((start + LOCAL_OFFSET_MS) / 1000, timezone.utc).date()
    days = math.ceil(n / MINUTES_A_DAY) + 1
    while True:
        since = day - timedelta(days=days)
        rows = with_small(tables.since(history, since), first, "symbol").where("__first IS NOT NULL")
        before = rows.where("open_time_ms < __first").groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"))
        short = stored(first.join(before, "symbol", "left").where(f"coalesce(__n, 0) < {n}").select("symbol"), "short-symbols")
        names = [r[0] for r in short.limit(NAMED_SYMBOLS + 1).collect()]
        older = tables.until(history, since)
        older = older.where(F.col("symbol").isin(names)) if len(names) <= NAMED_SYMBOLS else older.join(short, "symbol", "left_semi")
        if not names or older.select("symbol").isEmpty():
            return rows.drop("__first")
        days *= 4


def stale_days(history: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """(symbol, open_date, __from): the days that hold new rows, or rows with a new one among the n before them, and the first minute
    from which that is so."""
    first = stored(new.groupBy("symbol", "open_date").agg(F.min("open_time_ms").alias("__new")), "new-days")
    begin = first.groupBy("symbol").agg(F.min("open_date").alias("__day"))
    day = begin.agg(F.min("__day")).first()[0]
    if day is None:
        return first.select("symbol", "open_date", F.col("__new").alias("__from"))
    rows = with_small(tables.since(history, day).select("symbol", "open_date", "open_time_ms"), begin, "symbol").where("open_date >= __day")
    counts = rows.groupBy("symbol", "open_date").agg(F.count(F.lit(1)).alias("__n"), F.min("open_time_ms").alias("__start"))
    counts = counts.join(first, ["symbol", "open_date"], "left")
    w = Window.partitionBy("symbol").orderBy("open_date")
    through = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__through", through)
    last = F.max(F.when(F.col("__new").isNotNull(), F.col("__through"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = F.coalesce(F.col("__through") - F.col("__n") - last < n, F.lit(False))
    found = counts.withColumn("__from", F.when(near, F.col("__start")).otherwise(F.col("__new")))
    return found.where("__from IS NOT NULL").select("symbol", "open_date", "__from")


def fresh_scores(history: DataFrame, new: DataFrame, spec: tuple[Indicator, ...] = DEFAULT_SPEC, coefficients=FROZEN) -> DataFrame:
    """Scores of the new rows (symbol, open_date, open_time_ms) and of all that look back on them, from as many rows before each symbol's first as
    the spec needs."""
    n = rows_before(spec)
    days = stored(stale_days(history, new, n), "stale-days")
    first = stored(days.groupBy("symbol").agg(F.min("__from").alias("__first"), F.max("open_date").alias("__last")), "touched")
    rows = recent_rows(history, first.select("symbol", "__first"), n)
    rows = with_small(rows, first.select("symbol", "__last"), "symbol").where("open_date <= __last")
    made = score(features(rows.select("symbol", "open_time_ms", "close", "open_date"), spec), coefficients)
    return made.join(days, ["symbol", "open_date"]).where("open_time_ms >= __from").select("symbol", "open_date", "open_time_ms", "close", "predicted_proba_spike")


def put_scores(fresh: DataFrame, scores: str) -> list[str]:
    """Makes the written rows `fresh` the scores of their keys. Partitions that have older scores of them are replaced, each at once; to
    others they are appended. Done again, it changes nothing. Gives the folders that were left."""
    spark = fresh.sparkSession
    rows = tables.placed(fresh, scores)
    keys = ["symbol", "open_time_ms"]
    held = tables.within(spark.table(scores), tables.bounds(fresh))
    hit = tables.partitions(held.join(rows.select(*keys), keys, "left_semi"))
    if not hit:
        tables.append(rows, scores)
        return []
    inside = tables.in_partitions(rows, hit)
    kept = tables.in_partitions(spark.table(scores), hit).join(inside.select(*keys), keys, "left_anti")
    left = tables.replace(kept.select(*rows.columns).unionByName(inside), scores)
    chosen = spark.createDataFrame(hit, "bucket int, open_month string")
    tables.append(rows.join(F.broadcast(chosen), tables.KEYS, "left_anti"), scores)
    return left


def start_scoring(
    candles: DataFrame, table: str, scores: str, checkpoint: str, arrival: list[str], every: str | None = None,
    spec: tuple[Indicator, ...] = DEFAULT_SPEC, coefficients=FROZEN,
) -> StreamingQuery:
    """Ingests a stream of candles into `table` and keeps the table `scores` as a scoring of all stored candles would have it: new rows
    are scored as they come, and after a late row the scores of all that look back on it are replaced. Any order of arrival that leaves
    the same candles gives the same scores."""
    create_if_absent(candles.sparkSession, table)
    create_if_absent(candles.sparkSession, scores, SCORES)
    folder = f"{checkpoint}/candles"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = ingest_batch(batch, number, table, folder, arrival)
        if new is None:
            return
        fresh = once(fresh_scores(spark.table(table), new, spec, coefficients), f"{folder}/batch-{number}-scores")
        put_scores(fresh, scores)
        old = f"{folder}/batch-{number - 2}-scores"
        if exists(spark, old):
            remove(spark, old)

    return _started(candles, write, checkpoint, every)


class MeansState(StatefulProcessor):
    """RSI and MACD difference of each symbol, carried from batch to batch and given at once. Rows must come in the order of time from
    batch to batch; those at or before the last row are left out uncounted: features.py waits for a watermark and counts late rows. A micro-batch's rows of one symbol are held at once, so land the feed by time and
    bound the files of a trigger."""

    RSI = 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "means", "last_ms long, n long, close double, gain double, loss double, fast double, slow double, signal double"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, *means = self.state.get() if self.state.exists() else (-1, 0, *[None] * 6)
        close, gain, loss, fast, slow, signal = means
        frame = pd.concat([part[part["open_time_ms"] > last] for part in rows])
        frame = frame.sort_values("open_time_ms", kind="stable").drop_duplicates("open_time_ms")
        if len(frame):
            c, place = frame["close"].to_numpy(), n + np.arange(len(frame))
            if np.isnan(c).any():
                raise ValueError("a close is missing")
            move = np.diff(c, prepend=c[0] if close is None else close)
            ups, downs = (carried(np.maximum(m, 0), 1 / self.RSI, b) for m, b in ((move, gain), (-move, loss)))
            fasts, slows = carried(c, span(FAST), fast), carried(c, span(SLOW), slow)
            macd, diff = fasts - slows, np.full(len(c), np.nan)
            late = place >= SLOW - 1
            if late.any():
                signals = carried(macd[late], span(SIGNAL), signal)
                diff[late] = macd[late] - signals
                signal = float(signals[-1])
            diff[place < SLOW + SIGNAL - 2] = np.nan
            with np.errstate(divide="ignore", invalid="ignore"):
                rsi = np.where(downs == 0, 100.0, 100 - 100 / (1 + ups / downs))
            rsi[place < self.RSI - 1] = np.nan
            ends = [float(x[-1]) for x in (c, ups, downs, fasts, slows)]
            self.state.update((int(frame["open_time_ms"].iloc[-1]), int(n + len(c)), *ends, signal))
            none = lambda x: pd.Series(x, dtype=object).where(~np.isnan(x), None)
            yield pd.DataFrame(
                {"symbol": key[0], "open_time_ms": frame["open_time_ms"].to_numpy(), "close": c, "rsi_backward_14": none(rsi), "macd_diff": none(diff)}
            )

    def close(self) -> None:
        pass


def stateful_means(candles: DataFrame) -> DataFrame:
    """A stream of (symbol, open_time_ms, close) with its RSI and MACD difference; needs the RocksDB state store."""
    return candles.groupBy("symbol").transformWithStateInPandas(
        MeansState(), "symbol string, open_time_ms long, close double, rsi_backward_14 double, macd_diff double",
        outputMode="append", timeMode="none",
    )


def event_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A file stream over a Parquet file or folder. A pattern is given, since a stream takes no lone file by its name. files: how many
    a micro-batch takes, in the order of their writing."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def land(rows: DataFrame, folder: str, part: str, parts: int, most: int = LANDED) -> tuple[DataFrame, int]:
    """Writes rows part by part, one after the other, by the whole number `part` from 0, so a stream takes them in that order. All parts get the same number
    of files, about one for `most` rows of the largest part, each written by its own task: a stream that takes so many files at a time has a part in each
    micro-batch. Gives the rows, whose schema is the stream's, and that number."""
    spark, kept = rows.sparkSession, stored(rows, "to-land")
    # Rows are dealt out within a partition, so a file gets none only if no partition has as many rows of the part as there are files.
    held = kept.groupBy(part, F.spark_partition_id().alias("p")).count().groupBy(part).agg(F.sum("count").alias("n"), F.max("count").alias("m"))
    found = {r[part]: r for r in held.collect()}
    wanted = max((r.n for r in found.values()), default=0) // most
    files = max(1, min(wanted, LANDED_FILES, *(found[k].m if k in found else 1 for k in range(parts))))
    for k in range(parts):
        own = kept.where(F.col(part) == k).drop(part)
        own = own.coalesce(1) if files == 1 else _dealt(own, files)
        own.write.mode("append").parquet(folder)
    n = len(spark.read.schema(own.schema).parquet(folder).inputFiles())
    if n != files * parts:
        raise RuntimeError(f"{n} files were landed, not {files} for each of {parts} parts")
    return kept.drop(part), files


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows in n partitions; each deals its rows out in turn."""
    names = rows.columns
    return rows.withColumn("__to", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).repartitionById(n, "__to").select(*names)
