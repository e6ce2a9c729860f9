"""Connected components of links between ids, by alternating large-star and small-star steps on Spark.

No vertex's neighbours are ever gathered: each step takes minima by vertex, aggregated before the shuffle, and joins them
back. Few minima are broadcast; many are written first, so both sides of the join are exchanges whose skewed parts adaptive
execution splits: star links make hubs. Tables are written to the shared folder between steps.

Defined cases: links of an id to itself, repeated links and links told both ways count once; ids without links are left out; no
links give no rows. Ids must not be null: such a link is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Minima of at most so many vertices (16 bytes each) may be broadcast.
NARROW_ROWS = 500_000


def _star(links: DataFrame, large: bool, count: int) -> DataFrame:
    """links: (u, v) with u > v, `count` of them. Large star: a vertex's larger neighbours go to the least of its neighbourhood;
    small star: its smaller neighbours and itself do."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    # There are at most twice as many vertices as links.
    least = F.broadcast(least) if 2 * count <= NARROW_ROWS else stored(least, "least")
    moved = both.join(least, "u")
    if large:
        found = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return found.where("u > v").distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, label): label is the least id that can be reached; ids without links are left out. links: (u, v) of one type."""
    now = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _sum(now)
    while True:
        half = _star(now, True, before[0])
        if 2 * before[0] > NARROW_ROWS:
            half = stored(half, "half-step")
        now = stored(_star(half, False, before[0]), "links")
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
