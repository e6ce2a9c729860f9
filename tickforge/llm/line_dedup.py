"""Line dedup: lines that many documents hold lose all but one of their documents.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines over the
threshold are dropped and the rest reassembled by position. DataFrame functions only.

Defined cases: a null text is one empty line; an empty table gives an empty result; rows that repeat a
document id count as one document and each lose the same lines; a null id is an ordinary id, below all
others; other columns pass through unread, and one named n_lines or n_dropped is replaced. Ids may be of any type that
Spark can order. A text of any length is cut whole into its lines; of lines with one key all of the largest id stay, however many tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, carry, named, others, stored, unpacked

SALTS = 16
ADDED = ["n_lines", "n_dropped"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, hash, pos, h1, h2) for each line of rows (id, text, hash) whose key is long enough. The text's hash tells rows of one id
    apart; the two hashes of a key have independent seeds."""
    lines = F.transform(split_lines(F.coalesce("text", F.lit(""))), line_key)
    line = rows.select("id", "hash", F.posexplode(lines).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    return line.select("id", "hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def line_dedup(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with `text_col` reduced, and `n_lines` (before) and `n_dropped`. A key of at least `min_chars` code
    points found in at least `min_docs` documents stays only in the largest id that holds it."""
    names = others(docs, *ADDED)
    text = named(text_col)
    rows = docs.select(named(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), carry(docs, [c for c in names if c != text_col]))
    lines = stored(key_hashes(rows, min_chars), "line-hashes")
    common = (
        lines.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    dropped = (
        salted.join(common, ["h1", "h2", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n")
    joined = joined.withColumn("lines", split_lines(F.coalesce("text", F.lit("")))).select(
        "own", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    out = [F.col("text").alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in names]
    return joined.select(*out, *ADDED)
