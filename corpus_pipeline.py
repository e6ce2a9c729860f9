"""The corpus pipeline: quality rules, line dedup, near duplicates, source mix, piece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Written tables stand between the stages, so a lost executor costs a stage's tasks at most.

Defined cases, for all stages: docs have doc_id (whole numbers), text, lang and source, any of them null; a null text has no words,
no lines but an empty one, no shingles, no bytes and no pieces, and the quality rules reject it; a null id is an ordinary one, below
all others; other columns, whatever their names, pass through untouched (but n_chars, which follows the text); an empty table
gives an empty result. Rows that repeat an id: quality rules, near duplicates and pieces judge each row by its own text, line dedup
takes them as one document, the mix gives them one count. Rows equal in id and text share their fate in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import carry, stored
from tickforge.llm.line_dedup import line_dedup
from tickforge.llm.mixing import mix_sources
from tickforge.llm.ngram_join import NULL_ID, narrow, near_copies
from tickforge.llm.pieces import encode_pieces
from tickforge.llm.quality import quality
from tickforge.llm.queries import vocabulary

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, "0.8"
MODEL = "piece_bpe_32k.model"
#: Columns that the stages work on; the others travel in one struct, so they clash with none that an operator adds.
USED = ["doc_id", "text", "lang", "source"]


def packed(docs: DataFrame) -> DataFrame:
    return docs.select(*USED, carry(docs, [c for c in docs.columns if c not in USED]))


def restored(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs, out of a frame that comes from packed(docs)."""
    return [changed[c].alias(c) if c in changed else F.col(c) if c in USED else F.col("own").getField(c).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; a group without an estimate is judged by the base rules alone."""
    return quality(packed(docs)).where("kept").select(*restored(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in one document each, that of the largest id; n_chars follows the text. No row goes."""
    return line_dedup(packed(docs)).select(*restored(docs, n_chars=F.char_length("text").cast("long")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row of the least id (of one id: the least text hash) stays. Rows without words stay."""
    gone = stored(near_copies(docs, SHINGLE, SIMILARITY), "gone").select(F.col("doc").alias("gone_id"), F.col("own").alias("gone_text"))
    rows, gone = packed(docs), narrow(gone)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_text"))
    return rows.join(gone, same, "left_anti").select(*restored(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the same; documents repeat by Poisson counts, in a global shuffle. A source without bytes leaves."""
    return mix_sources(packed(docs)).select(*restored(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, n_pieces, and round_trip: whether the ids decode to the text. Columns of docs with these names are replaced."""
    made = encode_pieces(docs, vocabulary(MODEL), check_col="round_trip")
    return made.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_stage),
    ("source_mix", mix_stage),
    ("sentence_pieces", pieces_stage),
]
#: No SQL says the quality stage's estimates or the pieces; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
