"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS equal slots; each shard owns VNODES points on it. A row goes to the first point clockwise
from its id's hash whose shard still has room; the shard's capacity is its share of the rows plus slack. Rows
take a shard's room in the order of a second hash. Rounds: in each, all rows not yet placed look at the shards
still open; at least one shard fills up in every round but the last, so there are at most as many rounds as
shards. Ranks come from counts of hash buckets, so no task ever ranks a whole shard.

With slack 0 the capacities are exact: shard counts are at most one apart. Exactness is paid with movement: one more shard
makes every shard smaller, and what overflows goes on clockwise, so about half of the rows may move; with slack 0.25 about a fifth.

Defined cases: a null text has size 1 and the checksum of the empty text; a null id is hashed like any other
value; rows that repeat an id are ordered by checksum and size, equal rows in any order; an empty table gives an
empty result. Other columns aren't carried. Ids may be of any type that casts to string. Of texts of any
length only bytes and checksum are taken.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, stored
from .mixing import UNIT, hashed

SLOTS, VNODES = 4096, 64
#: Rows that one bucket of the second hash is meant to hold.
BUCKET_ROWS = 20_000
RANK = ["__order", "doc_id", "text_crc32", "size"]


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in ring order. A shard's points don't depend on how many there are."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}-{v}".encode()).digest()
            points.append((int.from_bytes(digest[:4], "big") % SLOTS, digest[4:8], shard))
    return [(slot, shard) for slot, _, shard in sorted(points)]


def owners(points: list[tuple[int, int]], open_shards: set[int]) -> list[int]:
    """For each slot, the shard of the first point at or after it, clockwise, among the open ones."""
    live = [p for p in points if p[1] in open_shards]
    found, at = [], 0
    for slot in range(SLOTS):
        while at < len(live) and live[at][0] < slot:
            at += 1
        found.append(live[at % len(live)][1])
    return found


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _bucket(n: int) -> Column:
    """Buckets 0 to n - 1 in the order of the second hash."""
    return F.floor(F.col("__order").cast("double") / UNIT * n).cast("int")


def _before(rows: DataFrame, shard: str) -> DataFrame:
    """(shard, __bucket, __in, __before): rows in each bucket and in those before it in the shard."""
    counts = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__in"))
    w = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__in").over(w), F.lit(0)))


def _per_shard(table: dict[int, int], otherwise: int) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("__shard")), F.lit(otherwise)) if pairs else F.lit(otherwise)


def _fill(rows: DataFrame, room: dict[int, int]) -> tuple[DataFrame, dict[int, int], int]:
    """rows with __kept, whether the row is among the first room[__shard] of its shard; how many each shard took;
    how many found no room. What comes to the driver is one row a shard."""
    counts = _before(rows, "__shard").withColumn("__room", _per_shard(room, 0))
    end = F.col("__before") + F.col("__in")
    edge = (F.col("__before") < F.col("__room")) & (end > F.col("__room"))
    found = (
        counts.groupBy("__shard")
        .agg(
            F.sum("__in").alias("rows"),
            F.max(F.when(end <= F.col("__room"), F.col("__bucket"))).alias("last"),
            F.max(F.when(edge, F.col("__bucket"))).alias("edge"),
            F.max(F.when(edge, F.col("__room") - F.col("__before"))).alias("part"),
        )
        .collect()
    )
    took = {r["__shard"]: min(r["rows"], room[r["__shard"]]) for r in found}
    whole = F.col("__bucket") <= _per_shard({r["__shard"]: r["last"] for r in found if r["last"] is not None}, -1)
    at_edge = F.col("__bucket") == _per_shard({r["__shard"]: r["edge"] for r in found if r["edge"] is not None}, -1)
    part = _per_shard({r["__shard"]: r["part"] for r in found if r["edge"] is not None}, 0)
    w = Window.partitionBy("__shard", "__bucket").orderBy(*RANK)
    ranked = rows.where(at_edge).withColumn("__kept", F.row_number().over(w) <= part)
    kept = rows.where(~at_edge).withColumn("__kept", whole).unionByName(ranked)
    return kept, took, sum(r["rows"] for r in found) - sum(took.values())


def shard_ring(
    docs: DataFrame, shards: int = 8, slack: float = 0.0, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot is gapless from 0 in each shard."""
    points = ring(shards, vnodes)
    key, text = named(id_col), F.coalesce(named(text_col), F.lit(""))
    base = stored(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(hashed("ring-place", key), F.lit(SLOTS)).cast("int").alias("__slot"),
            hashed("ring-order", key).alias("__order"),
        ),
        "ring-rows",
    )
    n = base.count()
    buckets = max(16, math.ceil(n / shards / BUCKET_ROWS))
    base = base.withColumn("__bucket", _bucket(buckets))
    room = dict(enumerate(capacities(n, shards, slack)))
    rest, placed = base, []
    left = n
    while left:
        open_shards = {s for s, r in room.items() if r > 0}
        table = F.split(F.lit(",".join(map(str, owners(points, open_shards)))), ",")
        asked = rest.withColumn("__shard", F.get(table, F.col("__slot")).cast("int"))
        kept, took, left = _fill(asked, {s: room[s] for s in open_shards})
        done = stored(kept, "ring-round") if left else kept
        placed.append(done.where("__kept"))
        room = {s: r - took.get(s, 0) for s, r in room.items()}
        rest = done.where(~F.col("__kept")).drop("__shard", "__kept")
    if not placed:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    w = Window.partitionBy("__shard", "__bucket").orderBy(*RANK)
    before = _before(whole, "__shard").drop("__in")
    return (
        whole.withColumn("__rank", F.row_number().over(w))
        .join(before, ["__shard", "__bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.col("__shard").alias("shard"),
            (F.col("__before") + F.col("__rank") - 1).cast("long").alias("slot"),
        )
    )
