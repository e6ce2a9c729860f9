"""Exponential means over series in which values are missing.

A value that comes g rows after the last one weighs alpha against (1 - alpha)^g, the two weights brought to a sum of one; a row
without a value keeps the mean. So a value maps the mean before it by y -> A y + B, and a series is a chain of such maps. The maps are composed within
segments in which the product of A falls by about e^-300: their bounds come from the running sum of -ln A, which blocks of rows and a
row a block give. A segment needs the end of the one before; what lies further back has decayed by e^-260.

Defined cases: keys (symbol, open_time_ms) must be unique; rows before a series' first value have no mean; a move from or to a missing
close is no move (0), as the RSI's is of the first row; the periods of a mean count values, those of the RSI count rows; columns named like
an added one are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .blocks import by_block, in_blocks, is_numbered, number_rows, without
from .indicators import FAST, SIGNAL, SLOW, span

#: What -ln A may sum up to in a segment.
FALL = 300.0
#: Rows of a block for running sums and for carrying values on.
BLOCK = 4096


def _numbered(rows: DataFrame) -> DataFrame:
    return rows if is_numbered(rows) else stored(number_rows(rows), "numbered")


def _running(rows: DataFrame, cost: str) -> DataFrame:
    """rows (symbol, __b, __i) with __sum: the sum of cost over the series up to the row."""
    totals = rows.groupBy("symbol", "__b").agg(F.sum(cost).alias("__total"))
    before = Window.partitionBy("symbol").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("symbol", "__b", F.coalesce(F.sum("__total").over(before), F.lit(0.0)).alias("__offset"))
    own = F.sum(cost).over(by_block().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own_sum", own).join(offsets, ["symbol", "__b"]).withColumn("__sum", F.col("__own_sum") + F.col("__offset")).drop("__own_sum", "__offset")


def chain(values: DataFrame, alpha: float) -> DataFrame:
    """(symbol, open_time_ms, at, n, y): the mean after each value of rows (symbol, open_time_ms, at, x), where `at` is the value's place in its
    series; n counts the values from 0."""
    placed = _numbered(values)
    rows = in_blocks(placed, back=1, block=BLOCK).withColumn("__gap", F.col("at") - F.lag("at", 1).over(by_block())).where("__own")
    old = F.exp(F.col("__gap") * math.log1p(-alpha))
    first = F.col("__i") == 0
    rows = rows.select(
        "symbol", "__b", "__i", "open_time_ms", "at",
        F.when(first, 0.0).otherwise(old / (old + alpha)).alias("__a"),
        F.when(first, F.col("x")).otherwise(alpha * F.col("x") / (old + alpha)).alias("__add"),
        F.when(first, 0.0).otherwise(F.least(-(F.col("__gap") * math.log1p(-alpha) - F.log(old + alpha)), F.lit(FALL))).alias("__cost"),
    )
    rows = _running(rows, "__cost").withColumn("__segment", F.floor(F.col("__sum") / FALL).cast("long"))
    rows = stored(rows.select("symbol", "__segment", "__i", "open_time_ms", "at", "__a", "__add", "__sum"), "segments")
    w = Window.partitionBy("symbol", "__segment").orderBy("__i")
    fall = F.col("__sum") - F.first("__sum").over(w)
    rows = rows.withColumns({"__fall": fall, "__enter": F.first("__a").over(w)})
    rows = rows.withColumn("__local", F.exp(-F.col("__fall")) * F.sum(F.col("__add") * F.exp(F.col("__fall"))).over(w))
    ends = rows.groupBy("symbol", (F.col("__segment") + 1).alias("__segment")).agg(F.max_by("__local", "__i").alias("__end"))
    y = F.col("__local") + F.col("__enter") * F.exp(-F.col("__fall")) * F.coalesce("__end", F.lit(0.0))
    return rows.join(ends, ["symbol", "__segment"], "left").select("symbol", "open_time_ms", "at", F.col("__i").alias("n"), y.alias("y"))


def kept_on(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(symbol, open_time_ms, __i, n, y): of every numbered row the newest value at or before it."""
    both = rows.select("symbol", "__i", "open_time_ms").join(values.select("symbol", F.col("at").alias("__i"), F.struct("n", "y").alias("__v")), ["symbol", "__i"], "left")
    blocked = in_blocks(both, block=BLOCK)
    here = blocked.withColumn("__v", F.last("__v", ignorenulls=True).over(by_block().rowsBetween(Window.unboundedPreceding, 0)))
    ends = here.groupBy("symbol", "__b").agg(F.max_by("__v", "__i").alias("__end"))
    before = Window.partitionBy("symbol").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "__b", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    value = F.coalesce("__v", "__before")
    return here.join(ends, ["symbol", "__b"]).select("symbol", "open_time_ms", "__i", value["n"].alias("n"), value["y"].alias("y"))


def _means(rows: DataFrame, alpha: float) -> DataFrame:
    known = rows.where("close IS NOT NULL").select("symbol", "open_time_ms", F.col("__i").alias("at"), F.col("close").alias("x"))
    return kept_on(rows, chain(known, alpha))


def _joined(rows: DataFrame, made: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.join(made.select("symbol", "__i", name), ["symbol", "__i"], "left").select(*columns, name)


def gap_mean(candles: DataFrame, alpha: float, periods: int = 1, name: str = "ema") -> DataFrame:
    """candles with the exponential mean of their closes, from the `periods`-th close on."""
    columns = without(candles, name)
    rows = _numbered(candles.select(*columns))
    made = _means(rows, alpha).select("symbol", "__i", F.when(F.col("n") >= periods - 1, F.col("y")).alias(name))
    return _joined(rows, made, columns, name)


def gap_rsi(candles: DataFrame, window: int = 14, name: str = "rsi") -> DataFrame:
    columns = without(candles, name)
    rows = _numbered(candles.select(*columns))
    moves = in_blocks(rows.select("symbol", "open_time_ms", "__i", "close"), back=1, block=BLOCK)
    moves = moves.withColumn("m", F.coalesce(F.col("close") - F.lag("close", 1).over(by_block()), F.lit(0.0))).where("__own")
    moves = stored(moves.select("symbol", "open_time_ms", F.col("__i").alias("at"), "m"), "moves")
    up, down = (chain(moves.select("symbol", "open_time_ms", "at", F.greatest(c, F.lit(0.0)).alias("x")), 1 / window) for c in (F.col("m"), -F.col("m")))
    both = up.select("symbol", F.col("at").alias("__i"), F.col("y").alias("u")).join(down.select("symbol", F.col("at").alias("__i"), F.col("y").alias("d")), ["symbol", "__i"])
    rsi = F.when(F.col("d") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("u", "d")))
    made = both.select("symbol", "__i", F.when(F.col("__i") >= window - 1, rsi).alias(name))
    return _joined(rows, made, columns, name)


def gap_macd_diff(candles: DataFrame, name: str = "macd_diff") -> DataFrame:
    """The signal's mean starts at the first row by which the slow mean has seen its SLOW closes."""
    columns = without(candles, name)
    rows = _numbered(candles.select(*columns))
    fast, slow = (_means(rows, span(n)).where(F.col("n") >= SLOW - 1) for n in (FAST, SLOW))
    macd = fast.select("symbol", "open_time_ms", "__i", F.col("y").alias("f")).join(slow.select("symbol", "__i", F.col("y").alias("s")), ["symbol", "__i"])
    macd = stored(macd.select("symbol", "open_time_ms", F.col("__i").alias("at"), (F.col("f") - F.col("s")).alias("x")), "macd")
    signal = chain(macd, span(SIGNAL)).select("symbol", "at", "n", "y")
    made = macd.join(signal, ["symbol", "at"]).select("symbol", F.col("at").alias("__i"), F.when(F.col("n") >= SIGNAL - 1, F.col("x") - F.col("y")).alias(name))
    return _joined(rows, made, columns, name)
