"""Candle sources: the raw positional feed, the stored table, and candles made from an event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: The twelve positions of a raw candle.
RAW_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades",
    "taker_buy_base", "taker_buy_quote", "ignore",
]
PRICES = ["open", "high", "low", "close", "volume"]

STORED = T.StructType(
    [
        T.StructField("open_time_ms", T.LongType()),
        T.StructField("open_time", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PRICES],
        T.StructField("symbol", T.StringType()),
        T.StructField("open_date", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("open_month", T.StringType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def explode_raw(lines: DataFrame, payload: str = "value") -> DataFrame:
    """Rows of lines whose `payload` is a JSON array of raw candles, one row a candle: the named fields as text and
    their position `pos` in the batch. Other columns stay."""
    parsed = lines.select(
        *[c for c in lines.columns if c != payload],
        F.posexplode(F.from_json(payload, "array<array<string>>")).alias("pos", "__raw"),
    )
    fields = [F.get("__raw", F.lit(i)).alias(name) for i, name in enumerate(RAW_FIELDS)]
    return parsed.select(*[c for c in parsed.columns if c != "__raw"], *fields)


def judged(raw: DataFrame, symbol: Column | str, arrival: list[str]) -> DataFrame:
    """Candles of raw rows, with `reject`: why a row is none (its symbol, time or close is missing), else null. Prices that are no numbers
    become null; a time that is no whole number is missing."""
    ms = F.col("open_time").try_cast("bigint")
    named = raw.select(
        (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        ms.alias("open_time_ms"),
        S.local_minute_text(ms).alias("open_time"),
        *[S.lenient_double(F.col(c)).alias(c) for c in PRICES],
        *arrival,
    ).withColumn("open_date", open_date())
    why = F.when(F.col("symbol").isNull(), "symbol").when(F.col("open_time_ms").isNull(), "time").when(F.col("close").isNull(), "close")
    return named.withColumn("reject", why)


def normalise(raw: DataFrame, symbol: Column | str, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candles, rejects): time series need a symbol, a time and a close."""
    rows = judged(raw, symbol, arrival)
    return rows.where("reject IS NULL").drop("reject"), rows.where("reject IS NOT NULL").drop("reject")


def open_date() -> Column:
    """The day of the local minute."""
    return F.substring("open_time", 1, 10).cast("date")


def as_stored(candles: DataFrame, *more: str) -> DataFrame:
    """Candles with the columns of a stored table but those that place them, in its order, and the named ones. Prices that aren't given
    are null; the local minute and the day follow from the time."""
    kinds = {f.name: f.dataType for f in STORED.fields if f.name not in ("bucket", "open_month")}
    rows = candles.withColumn("open_time", S.local_minute_text(F.col("open_time_ms"))).withColumn("open_date", open_date())
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()], *more)


def from_events(events: DataFrame, symbol: Column | str = "event_type") -> DataFrame:
    """(symbol, open_time_ms, close, arrival): an event is an offer of a candle for its minute; one without a value is none."""
    name = F.col(symbol) if isinstance(symbol, str) else symbol
    rows = events.select(
        name.alias("symbol"), S.ntz_minute_ms(F.col("ts")).alias("open_time_ms"),
        S.nan_to_null(F.col("value")).alias("close"), F.col("event_id").alias("arrival"),
    )
    return rows.where(F.col("close").isNotNull())


def between(candles: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Candles of the half-open range of milliseconds; the unfinished minute is the next run's."""
    return candles.where((F.col("open_time_ms") >= start_ms) & (F.col("open_time_ms") < end_ms))


def between_text(candles: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, open_time, close) with both ends included; ISO text sorts as time does."""
    return candles.where(F.col("open_time").between(first, last)).select("symbol", "open_time", "close")


def events_between_text(events: DataFrame, first: str, last: str) -> DataFrame:
    """The events of those minutes, by bounds on the raw time: a minute lies wholly in or out, so this may go before whatever
    takes one row of a minute, down to the scan."""
    minute = lambda text, more: (datetime.strptime(text, "%Y-%m-%d %H:%M") - timedelta(milliseconds=S.LOCAL_OFFSET_MS) + more).isoformat(" ")
    low, high = (F.lit(minute(t, m)).cast("timestamp_ntz") for t, m in ((first, timedelta(0)), (last, timedelta(minutes=1))))
    return events.where((F.col("ts") >= low) & (F.col("ts") < high))
