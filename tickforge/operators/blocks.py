"""Order-sensitive work on series of any length: rows are numbered, cut into blocks and windowed by block.

A window over a whole symbol puts the symbol into one task. Here each row knows its place in its series, a block is
a bounded run of places, and rows near a block's ends are copied to the neighbour that needs them.

Names that begin with two underscores are working columns: candles that have some of their own are refused. An added column replaces
one of its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
BLOCK = 4096
#: Marks the places that number_rows gave.
PLACES = {"tickforge": "place"}


def by_block():
    return Window.partitionBy("symbol", "__b").orderBy("__i")


def is_numbered(candles: DataFrame) -> bool:
    """Whether the rows have their places; raises for other working columns."""
    own = [c for c in candles.columns if c.startswith("__")]
    if own and (own != ["__i"] or candles.schema["__i"].metadata != PLACES):
        raise ValueError(f"names that begin with two underscores are working columns: {own}")
    return bool(own)


def without(candles: DataFrame, *added: str) -> list[str]:
    """The columns of candles that an operator hands on beside those that it adds."""
    gone = {c.lower() for c in added}
    return [c for c in candles.columns if c.lower() not in gone]


def number_rows(candles: DataFrame) -> DataFrame:
    """candles with __i, the row's place in its symbol from 0. Keys must be unique, so a symbol's day is at most
    1,440 rows; only day counts are summed along the series. Rows that have their places keep them."""
    if is_numbered(candles):
        return candles
    day = F.floor(F.col("open_time_ms") / DAY_MS).cast("long")
    rows = candles.withColumn("__day", day)
    sums = Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("symbol", "__day").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("symbol", "__day", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__before"))
    within = Window.partitionBy("symbol", "__day").orderBy("open_time_ms")
    placed = rows.withColumn("__r", F.row_number().over(within) - 1).join(offsets, ["symbol", "__day"])
    return placed.select(*candles.columns, (F.col("__r") + F.col("__before")).alias("__i", metadata=PLACES))


def spread(rows: DataFrame, blocks: int) -> DataFrame:
    """rows by (symbol, __b), in as many partitions as there are blocks, at most the session's shuffle partitions. Blocks are few bytes and
    much work, so partitions made of bytes would put many into one task. Windows by block need no shuffle after this one."""
    parts = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "symbol", "__b") if parts > 1 else rows


def in_blocks(numbered: DataFrame, back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Rows by block __b, with __own false for the `back` rows before and `ahead` rows after the block that are
    there only to be looked at."""
    if max(back, ahead) > block:
        raise ValueError("a block must be as long as the frames that reach beyond it")
    own = F.floor(F.col("__i") / block).cast("long")
    place = F.pmod(F.col("__i"), F.lit(block))
    copies = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    skip = F.lit(None).cast("struct<b:bigint,own:boolean>")
    if back:
        copies.append(F.when(place >= block - back, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))).otherwise(skip))
    if ahead:
        copies.append(F.when((place < ahead) & (own > 0), F.struct((own - 1).alias("b"), F.lit(False).alias("own"))).otherwise(skip))
    if len(copies) == 1:
        return numbered.withColumn("__b", own).withColumn("__own", F.lit(True))
    return (
        numbered.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
        .withColumn("__b", F.col("__c.b"))
        .withColumn("__own", F.col("__c.own"))
        .drop("__c")
    )


def block_for(alphas: list[float]) -> int:
    """The longest block in which no weight of an exponential mean leaves e**300."""
    return min(int(300 / -math.log1p(-a)) for a in alphas)


def place_in(block: int) -> Column:
    return F.pmod(F.col("__i"), F.lit(block)).cast("double")


def weight(alpha: float, first: int) -> Column:
    return F.when(F.col("__i") < first, 0.0).when(F.col("__i") == first, 1.0).otherwise(alpha)


def block_mean(source: Column, alpha: float, first: int, block: int) -> Column:
    """The exponential mean of a block's rows up to this one, as if nothing came before the block. A missing value raises: a mean over
    a gap is not defined."""
    p, keep = place_in(block), F.lit(1 - alpha)
    value = F.when(F.col("__i") < first, 0.0).otherwise(F.coalesce(source, F.raise_error(F.lit("a close is missing")).cast("double")))
    return F.pow(keep, p) * F.sum(weight(alpha, first) * value * F.pow(keep, -p)).over(by_block())


def with_carry(local: Column, carry: Column, alpha: float, block: int) -> Column:
    """The mean itself: what a block's end hands on fades from row to row. What lies further back has decayed by e**-300."""
    return local + F.pow(F.lit(1 - alpha), place_in(block) + 1) * F.coalesce(carry, F.lit(0.0))


def after(value: Column, first: int, periods: int) -> Column:
    """value from the row on that has `periods` rows since the first."""
    return F.when(F.col("__i") >= first + periods - 1, value)
