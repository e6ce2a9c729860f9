"""What the text operators share: word rules, columns that are carried along, size-checked joins and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import named, with_small
from ..sources.scratch import shared_dir, stored

__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "ascii_lower", "carry", "named", "others", "shared_dir", "stored", "unpacked", "with_small"]

#: Characters that separate words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def others(docs: DataFrame, *replaced: str) -> list[str]:
    """Names of the columns of docs that no replaced one clashes with; Spark's names know no case."""
    gone = {c.lower() for c in replaced}
    return [c for c in docs.columns if c.lower() not in gone]


def carry(docs: DataFrame, names: list[str]) -> Column:
    """The named columns as one struct `own`, in which they clash with no working column. unpacked() takes them out again."""
    return F.struct(*[named(c) for c in names] or [F.lit(0).alias("none")]).alias("own")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("own").getField(c).alias(c) for c in names]
