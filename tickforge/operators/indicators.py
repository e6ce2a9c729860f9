"""Indicators and the spec that names them. All frames count rows, as the candles come, not minutes.

Candles are numbered and written once; what the exponential means hand on from block to block is a table of one row a block; then all
columns are made in one pass over the blocks.

Defined cases: keys (symbol, open_time_ms) must be unique; a missing close leaves its frames without a value and fails the exponential
means (ingest rejects such rows); a flat series has an RSI of 100; a zero divisor gives a signed infinity, 0 / 0 null; columns
named like an indicator are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ieee_ratio
from ..sources.scratch import stored
from .blocks import BLOCK, after, block_for, block_mean, by_block, in_blocks, is_numbered, number_rows, place_in, spread, weight, with_carry, without
from .joins import BROADCAST_ROWS


@dataclass(frozen=True)
class Indicator:
    kind: str  # rsi, roc, macd_diff, sma_ratio, bb_width
    window: int | None = None
    name: str | None = None

    @property
    def column(self) -> str:
        stem = self.name or self.kind
        return f"{stem}_{self.window}" if self.window else stem


#: The default features.
DEFAULT_SPEC = (
    Indicator("rsi", 14, "rsi_backward"),
    Indicator("roc", 14),
    Indicator("roc", 140),
    Indicator("macd_diff"),
    Indicator("sma_ratio", 14),
    Indicator("sma_ratio", 140),
    Indicator("bb_width", 14),
    Indicator("bb_width", 140),
)
FAST, SLOW, SIGNAL = 12, 26, 9
#: Sums of long frames are made of sums of so many rows, by place in the series: the order in which DuckDB adds up frames of up to 255 rows.
RUN = 16


def rate_of_change(k: int) -> Column:
    before = F.lag("close", k).over(by_block())
    return ieee_ratio(F.col("close") - before, before) * 100


def _trailing(k: int):
    return by_block().rowsBetween(-(k - 1), 0)


def _full(k: int, value: Column) -> Column:
    return F.when(F.count("close").over(_trailing(k)) >= k, value)


def mean_of(rows: DataFrame, k: int) -> DataFrame:
    """rows with __mean<k>, the mean of the last k closes, added up in one order: the rows before the first run that lies in the frame, the sums of
    such runs, the rows after them. The order decides the last bit, and that the last place where a quotient is an exact half."""
    if k < RUN:
        return rows.withColumn(f"__mean{k}", F.avg("close").over(_trailing(k)))
    place = F.pmod(F.col("__i"), F.lit(RUN)).cast("int")
    before, since = F.pmod(k - 1 - place, F.lit(RUN)), F.pmod(place + 1, F.lit(RUN))  # how many rows
    listed = lambda name, first, last: F.collect_list(name).over(by_block().rowsBetween(-first, -last))
    rows = rows.withColumn("__run", F.when(place == RUN - 1, F.sum("close").over(_trailing(RUN))))
    rows = rows.withColumns({"__old": listed("close", k - 1, k - RUN + 1), "__runs": listed("__run", k - RUN, 0), "__new": listed("close", RUN - 2, 0)})
    parts = F.concat(F.slice("__old", F.lit(1), before), "__runs", F.slice("__new", RUN - since, since))
    total = F.aggregate(parts, F.lit(0.0), lambda total, value: total + value)
    return rows.withColumn(f"__mean{k}", total / k).drop("__run", "__old", "__runs", "__new")


def sma_ratio(k: int) -> Column:
    return _full(k, ieee_ratio(F.col("close"), F.col(f"__mean{k}")))


def bb_width(k: int) -> Column:
    return _full(k, ieee_ratio(400 * F.stddev_pop("close").over(_trailing(k)), F.col(f"__mean{k}")))


FRAMES = {"roc": (rate_of_change, 0), "sma_ratio": (sma_ratio, 1), "bb_width": (bb_width, 1)}


def span(n: int) -> float:
    return 2 / (n + 1)


def simple_means(spec: tuple[Indicator, ...]) -> dict[str, tuple[str, float]]:
    """name -> (source, alpha) of the means that start at a series' first row."""
    found: dict[str, tuple[str, float]] = {}
    for s in spec:
        if s.kind == "rsi":
            found |= {f"__gain_{s.window}": ("__gain", 1 / s.window), f"__loss_{s.window}": ("__loss", 1 / s.window)}
        elif s.kind == "macd_diff":
            found |= {"__fast": ("close", span(FAST)), "__slow": ("close", span(SLOW))}
    return found


def rows_before(spec: tuple[Indicator, ...]) -> int:
    """How many rows before a row decide its indicators to less than e**-60 of their size."""
    frames = [s.window for s in spec if s.kind in FRAMES]
    rsi = [60 * s.window for s in spec if s.kind == "rsi"]
    macd = [30 * (SLOW + 1) + 30 * (SIGNAL + 1)] if any(s.kind == "macd_diff" for s in spec) else []
    return max(frames + rsi + macd + [1])


def _moves() -> dict[str, Column]:
    move = F.col("close") - F.lag("close", 1).over(by_block())
    up = lambda c: F.when(F.col("__i") == 0, 0.0).when(c > 0, c).when(c <= 0, 0.0)
    return {"__gain": up(move), "__loss": up(-move)}


def _carries(numbered: DataFrame, means: dict[str, tuple[str, float]], block: int, signal: bool) -> DataFrame:
    """(symbol, __b, __c<mean>): what each block gets from the one before. One row a block. The signal's share of its input's carry is
    a sum of powers, so it needs no pass of its own."""
    rows = in_blocks(numbered.select("symbol", "__i", "close"), back=1, block=block).withColumns(_moves()).where("__own")
    rows = rows.withColumns({n: block_mean(F.col(source), alpha, 0, block) for n, (source, alpha) in means.items()})
    ends = [F.max_by(n, "__i").alias(n) for n in means]
    if signal:
        a, first, p = span(SIGNAL), SLOW - 1, place_in(block)
        share = weight(a, first) * F.pow(F.lit(1 - a), block - 1 - p)
        fade = lambda n: F.sum(share * F.pow(F.lit(1 - span(n)), p + 1))
        ends += [F.sum(share * (F.col("__fast") - F.col("__slow"))).alias("__signal"), fade(FAST).alias("__kf"), fade(SLOW).alias("__ks")]
    ends = stored(rows.groupBy("symbol", "__b").agg(*ends), "block-ends")
    names = [*means, *(["__signal"] if signal else [])]
    if signal:
        last = ends.select("symbol", (F.col("__b") + 1).alias("__b"), F.col("__fast").alias("__pf"), F.col("__slow").alias("__ps"))
        ends = ends.join(last, ["symbol", "__b"], "left").withColumn(
            "__signal", F.col("__signal") + F.coalesce(F.col("__pf") * F.col("__kf") - F.col("__ps") * F.col("__ks"), F.lit(0.0))
        )
    return stored(ends.select("symbol", (F.col("__b") + 1).alias("__b"), *[F.col(n).alias(f"__c{n}") for n in names]), "carries")


def _joined(rows: DataFrame, carries: DataFrame, blocks: int) -> DataFrame:
    return rows.join(F.broadcast(carries) if blocks <= BROADCAST_ROWS else carries, ["symbol", "__b"], "left")


def features(candles: DataFrame, spec: tuple[Indicator, ...] = DEFAULT_SPEC) -> DataFrame:
    """candles with a column for each indicator."""
    columns = without(candles, *[s.column for s in spec])
    numbered = candles if is_numbered(candles) else stored(number_rows(candles.select(*columns)), "numbered")
    means = simple_means(spec)
    signal = any(s.kind == "macd_diff" for s in spec)
    alphas = [a for _, a in means.values()] + [span(SIGNAL)] * signal
    back = max([1] + [s.window - FRAMES[s.kind][1] for s in spec if s.kind in FRAMES])
    block = block_for(alphas) if alphas else max(back, BLOCK - back)
    if back > block:
        raise ValueError("windows of the frames are longer than a block of the exponential means")
    carries = _carries(numbered, means, block, signal) if means else None
    blocks = carries.count() if means else numbered.count() // block + 1
    rows = spread(in_blocks(numbered, back=back, block=block), blocks)
    for k in sorted({s.window for s in spec if s.kind in ("sma_ratio", "bb_width")}):
        rows = mean_of(rows, k)
    made = {s.column: FRAMES[s.kind][0](s.window) for s in spec if s.kind in FRAMES}
    rows = rows.withColumns(made | (_moves() if means else {})).where("__own")
    if means:
        rows = rows.withColumns({n: block_mean(F.col(source), alpha, 0, block) for n, (source, alpha) in means.items()})
        rows = _joined(rows, carries, blocks)
        rows = rows.withColumns({n: with_carry(F.col(n), F.col(f"__c{n}"), alpha, block) for n, (_, alpha) in means.items()})
    for s in spec:
        if s.kind == "rsi":
            gain, loss = F.col(f"__gain_{s.window}"), F.col(f"__loss_{s.window}")
            rsi = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
            rows = rows.withColumn(s.column, after(rsi, 0, s.window))
        elif s.kind == "macd_diff":
            first, alpha = SLOW - 1, span(SIGNAL)
            rows = rows.withColumn("__macd", F.col("__fast") - F.col("__slow"))
            rows = rows.withColumn("__signal", block_mean(F.col("__macd"), alpha, first, block))
            whole = with_carry(F.col("__signal"), F.col("__c__signal"), alpha, block)
            rows = rows.withColumn(s.column, after(F.col("__macd") - whole, first, SIGNAL))
    return rows.select(*columns, *[s.column for s in spec])


def exponential_mean(candles: DataFrame, alpha: float, periods: int = 1, name: str = "ema") -> DataFrame:
    columns = without(candles, name)
    numbered = candles if is_numbered(candles) else stored(number_rows(candles.select(*columns)), "numbered")
    block = block_for([alpha])
    means = {"__mean": ("close", alpha)}
    carries = _carries(numbered, means, block, False)
    blocks = carries.count()
    rows = spread(in_blocks(numbered, block=block), blocks).withColumn("__mean", block_mean(F.col("close"), alpha, 0, block))
    rows = _joined(rows, carries, blocks)
    return rows.select(*columns, after(with_carry(F.col("__mean"), F.col("__c__mean"), alpha, block), 0, periods).alias(name))
