"""Labels: the forward maximum, its ratio to the close, and the flag of the highest ratios.

Defined cases: keys (symbol, open_time_ms) must be unique; a missing close is no maximum, and has no ratio and the flag 0; frames are shorter
at a series' end; ties at the threshold are all flagged; columns named like an added one are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ieee_ratio, nan_to_null
from ..sources.scratch import stored
from .blocks import by_block, in_blocks, number_rows, without
from .joins import with_small

AHEAD = 240
#: Groups up to this size are ranked whole; larger ones only near the quantile, in a bracket that holds at most NEAR_ROWS rows.
WHOLE, NEAR_ROWS = 10_000, 200_000
#: A bracket is a part of GRID equal parts by rank, and its neighbours, of the bracket before.
GRID, ACCURACY = 100, 10_000


def forward_max(candles: DataFrame, rows: int = AHEAD) -> DataFrame:
    """candles with rolling_max: the largest close of this row and the rows - 1 after it, fewer at the end."""
    blocked = in_blocks(number_rows(candles), ahead=rows - 1)
    top = F.max("close").over(by_block().rowsBetween(0, rows - 1))
    return blocked.select("*", top.alias("__top")).where("__own").select(*without(candles, "rolling_max"), F.col("__top").alias("rolling_max"))


def forward_max_two_scans(candles: DataFrame, rows: int = AHEAD) -> DataFrame:
    """The same in two scans whatever the frame's length: a frame is the tail of one block of `rows` rows and the head
    of the next, so it is the larger of a suffix and a prefix maximum."""
    blocked = in_blocks(number_rows(candles), block=rows)
    scanned = blocked.withColumn("__head", F.max("close").over(by_block().rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "__tail", F.max("close").over(by_block().rowsBetween(0, Window.unboundedFollowing))
    )
    p = F.pmod(F.col("__i"), F.lit(rows))
    # The head that a row needs is rows - 1 further on: place p - 1 of the next block, or that block's last row.
    heads = scanned.select("symbol", (F.col("__b") - 1).alias("__b"), (p + 1).alias("__p"), F.col("__head").alias("__next"))
    ends = scanned.groupBy("symbol", (F.col("__b") - 1).alias("__b")).agg(F.max_by("__head", "__i").alias("__end"))
    joined = scanned.withColumn("__p", p).join(ends, ["symbol", "__b"], "left").join(heads, ["symbol", "__b", "__p"], "left")
    reach = F.when(p == 0, F.col("__tail")).otherwise(F.greatest("__tail", F.coalesce("__next", "__end")))
    return joined.select("*", reach.alias("__top")).select(*without(candles, "rolling_max"), F.col("__top").alias("rolling_max"))


def ratio(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("ratio", nan_to_null(ieee_ratio(F.col("rolling_max"), F.col("close"))))


def _brackets(known: DataFrame, q: float) -> DataFrame:
    """(symbol, n, below, lo, hi): bounds around the quantile, and the rows below them. Few rows: no bounds at all."""
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    rank = F.lit(q) * (F.col("n") - 1)

    def narrowed(groups: DataFrame, below, inside) -> DataFrame:
        at = F.floor((rank - below) / inside * GRID).cast("int")
        return groups.select(
            "symbol", "n", F.greatest(F.get("e", F.greatest(at - 1, F.lit(0))), F.col("lo")).alias("lo"),
            F.least(F.get("e", F.least(at + 2, F.lit(GRID))), F.col("hi")).alias("hi"),
        )

    groups = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), grid.alias("e")).withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf")))
    large = F.col("n") > WHOLE
    first = stored(groups, "quantile-groups")
    now = first.where(~large).select("symbol", "n", "lo", "hi").unionByName(narrowed(first.where(large), F.lit(0), F.col("n")))
    inner = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    while True:
        placed = with_small(known, now, "symbol")
        counted = placed.groupBy("symbol", "n", "lo", "hi").agg(
            F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inner).alias("inside"),
            F.percentile_approx(F.when(inner, F.col("v")), [i / GRID for i in range(GRID + 1)], ACCURACY).alias("e"),
        )
        counted = stored(counted, "quantile-bracket")
        # Ties can't be cut; they are ranked as one row.
        wide = (F.col("inside") > NEAR_ROWS) & (F.col("lo") < F.col("hi"))
        again = narrowed(counted.where(wide), F.col("below"), F.col("inside"))
        moved = again.join(counted.select("symbol", F.col("lo").alias("l"), F.col("hi").alias("h")), "symbol").where("lo > l OR hi < h").drop("l", "h")
        if moved.isEmpty():
            return counted.select("symbol", "n", "below", "lo", "hi")
        now = counted.join(moved.select("symbol"), "symbol", "left_anti").select("symbol", "n", "lo", "hi").unionByName(moved)


def exact_quantile(rows: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """(symbol, name): the quantile with linear interpolation, nulls left out. Sketches bracket it, rows below the
    bracket are counted, and only those inside it are ranked; so a long series is never gathered."""
    known = rows.where(F.col(value).isNotNull()).select("symbol", F.col(value).alias("v"))
    placed = with_small(known, _brackets(known, q), "symbol")
    near = placed.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    # Equal values take one row and a count, so ties don't gather either.
    return quantile_of_steps(near.groupBy("symbol", "n", "below", "v").agg(F.count(F.lit(1)).alias("same")), q, name)


def quantile_of_steps(steps: DataFrame, q: float, name: str) -> DataFrame:
    """(symbol, name): the quantile of n values, for the distinct ones around it (symbol, n, below, v, same): how many are below all of
    these, and how many are equal. Null where it would lie between an infinite value and another."""
    w = Window.partitionBy("symbol").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("to", F.sum("same").over(w))
    pos = F.lit(q) * (F.col("n") - 1)
    last = F.col("below") + F.col("to") - 1
    found = ranked.withColumn("f", pos - F.floor(pos)).groupBy("symbol").agg(
        F.min(F.when(last >= F.floor(pos), F.col("v"))).alias("a"),
        F.min(F.when(last >= F.least(F.floor(pos) + 1, F.col("n") - 1), F.col("v"))).alias("z"),
        F.first("f").alias("f"),
    )
    a, z, f = F.col("a"), F.col("z"), F.col("f")
    value_at = F.when(a == z, a).when(f < 0.5, a + (z - a) * f).otherwise(z - (z - a) * (1 - f))
    return found.select("symbol", nan_to_null(value_at).alias(name))


def spike_flag(with_ratio: DataFrame, q: float = 0.9, scope: DataFrame | None = None) -> DataFrame:
    """with_ratio with p90 and spike_flag. scope: rows that set the threshold, by default all of them; give the
    training rows to keep the future out of it."""
    levels = stored(exact_quantile(with_ratio if scope is None else scope, "ratio", q, "p90"), "levels")
    flag = F.coalesce((F.col("ratio") >= F.col("p90")).cast("int"), F.lit(0))
    rows = with_ratio.select(*without(with_ratio, "p90", "spike_flag"))
    return with_small(rows, levels, "symbol").withColumn("spike_flag", flag)
