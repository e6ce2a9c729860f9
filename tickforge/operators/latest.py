"""The newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(candles: DataFrame, n: int = 5) -> DataFrame:
    """The n newest rows, newest first."""
    return candles.orderBy(F.desc("open_time_ms"), F.desc("open_time"), F.desc("symbol")).limit(n)


def tail(candles: DataFrame, n: int = 5) -> DataFrame:
    """The n newest rows in the order of time."""
    return newest(candles, n).orderBy("open_time_ms", "open_time", "symbol")


def newest_per_symbol(candles: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time_ms"))
    return candles.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
