"""Joins to small tables: broadcast only after a count, else a shuffle in which hot keys are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows of fixed width (a few MB) may be broadcast.
BROADCAST_ROWS = 50_000


def named(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashed_row(df: DataFrame) -> Column:
    """A number from a row's values; maps, which Spark doesn't hash, are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[named(c) for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def with_small(df: DataFrame, table: DataFrame, key: str, salts: int = 32, width: Column | None = None, rows: int | None = None) -> DataFrame:
    """Left join to a table with few rows a key. Broadcast if its rows are counted to be few;
    else a shuffle join in which every key is spread over `salts` parts. Null keys match. width: how many rows of fixed
    width a row counts for, where it holds arrays. rows: their number, where it is known."""
    names = [c for c in table.columns if c != key]
    if rows is None:
        rows = table.count() if width is None else table.agg(F.sum(width)).first()[0] or 0
    if rows <= BROADCAST_ROWS:
        right = F.broadcast(table.withColumnRenamed(key, "__key"))
        on = df[key].eqNullSafe(right["__key"])
        return df.join(right, on, "left").drop("__key")
    left = df.withColumn("__salt", F.pmod(hashed_row(df), F.lit(salts)).cast("int"))
    right = table.withColumnRenamed(key, "__key").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__part"])
    return left.join(right, on, "left").select(*df.columns, *names)
