"""Ratios of the forward maximum to the close, kept up as candles are appended, with sketches of them for the threshold.

A row's ratio looks at the rows after it, so a batch gives ratios to its own rows and new ones to the rows before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import kept_quantiles, labels, tables
from ..operators.ingest import create_if_absent
from ..operators.joins import with_small
from ..sources.candles import STORED
from ..sources.scratch import exists, once, remove, stored
from .candles import _started, ingest_batch, put_scores, recent_rows

RATIOS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open_time_ms", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("close", "rolling_max", "ratio")],
        T.StructField("open_date", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("open_month", T.StringType()),
    ]
)


def fresh_ratios(history: DataFrame, new: DataFrame, ahead: int = labels.AHEAD) -> DataFrame:
    """Ratios of the new rows and of all that have one of them in their frame: from ahead - 1 rows before a symbol's first new row to its
    last. Rows from then on are read, so a row that is a year late costs its symbol's rows since then."""
    ends = stored(new.groupBy("symbol").agg(F.min("open_time_ms").alias("__first"), F.max("open_time_ms").alias("__last")), "touched")
    rows = recent_rows(history, ends.select("symbol", "__first"), ahead - 1).select("symbol", "open_date", "open_time_ms", "close")
    rated = with_small(labels.ratio(labels.forward_max_two_scans(rows, ahead)), ends, "symbol").where("open_time_ms <= __last")
    before = rated.where("open_time_ms < __first")
    near = before.withColumn("__back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time_ms")))).where(F.col("__back") < ahead)
    columns = [c for c in RATIOS.names if c not in tables.KEYS]
    return near.select(*columns).unionByName(rated.where("open_time_ms >= __first").select(*columns))


def put_ratios(fresh: DataFrame, ratios: str, sketches: str) -> list[str]:
    """Makes the written rows `fresh` the ratios of their keys, and the sketches of their partitions again. Done again, it changes nothing.
    Gives the folders that were left."""
    left = put_scores(fresh, ratios)
    touched = tables.partitions(tables.placed(fresh, ratios))
    return left + kept_quantiles.sketch_partitions(fresh.sparkSession, ratios, "ratio", sketches, touched)


def start_ratios(
    candles: DataFrame, table: str, ratios: str, sketches: str, checkpoint: str, arrival: list[str], every: str | None = None, ahead: int = labels.AHEAD
) -> StreamingQuery:
    """Ingests a stream of candles into `table`, and keeps the tables `ratios` and `sketches` as all stored candles give them. The
    threshold is kept_quantile(spark.table(ratios), spark.table(sketches), "ratio", q, name)."""
    for name, schema in ((table, STORED), (ratios, RATIOS), (sketches, kept_quantiles.SKETCHES)):
        create_if_absent(candles.sparkSession, name, schema)
    folder = f"{checkpoint}/candles"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = ingest_batch(batch, number, table, folder, arrival)
        if new is None:
            return
        fresh = once(fresh_ratios(spark.table(table), new, ahead), f"{folder}/batch-{number}-ratios")
        put_ratios(fresh, ratios, sketches)
        old = f"{folder}/batch-{number - 2}-ratios"
        if exists(spark, old):
            remove(spark, old)

    return _started(candles, write, checkpoint, every)
