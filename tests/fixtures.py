"""Candles for tests, and the published formulas in pandas."""

import pandas as pd
from pyspark.sql import functions as F

from tickforge.functions import scalars as S
from tickforge.operators import ingest
from tickforge.sources import candles as C

SF = "/root/testdata/sf0.01"
SERIES = [10.0, 11.0, 11.0, 9.0, 12.0, 12.0, 8.0]


def one_series(spark, folder=SF):
    rows = C.from_events(spark.read.parquet(f"{folder}/events.parquet"), F.lit("EVT"))
    rows = rows.withColumn("open_time", S.local_minute_text(F.col("open_time_ms")))
    return ingest.first_of_minute(rows, ["arrival"]).select("symbol", "open_time_ms", "open_time", "close")


def series(spark, values, symbol="A", step=1):
    rows = [(symbol, i * step * 60_000, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, open_time_ms long, close double")


def values(df, name):
    return [r[name] for r in df.orderBy("symbol", "open_time_ms").collect()]


def by_formula(close: pd.Series) -> pd.DataFrame:
    """Every default indicator, one candle after another."""
    out = pd.DataFrame({"close": close})
    move = close.diff()
    mean = lambda x, a, n: x.ewm(alpha=a, adjust=False, min_periods=n).mean()
    up, down = move.clip(lower=0).fillna(0), (-move).clip(lower=0).fillna(0)
    gain, loss = mean(up, 1 / 14, 14), mean(down, 1 / 14, 14)
    rsi = 100 - 100 / (1 + gain / loss)
    out["rsi_backward_14"] = rsi.where(loss != 0, 100).where(loss.notna())
    macd = mean(close, 2 / 13, 12) - mean(close, 2 / 27, 26)
    out["macd_diff"] = macd - macd.ewm(alpha=0.2, adjust=False, min_periods=9).mean()
    for k in (14, 140):
        out[f"roc_{k}"] = (close - close.shift(k)) / close.shift(k) * 100
        out[f"sma_ratio_{k}"] = close / close.rolling(k).mean()
        out[f"bb_width_{k}"] = 400 * close.rolling(k).std(ddof=0) / close.rolling(k).mean()
    return out
