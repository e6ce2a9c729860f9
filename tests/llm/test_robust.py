"""Every operator and stage on odd tables: extra columns with clashing names, nulls, repeats, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickforge.llm import lexical_search, line_dedup, mixing, mpeg, ngram_join, pieces, quality, sharding, substring_dedup, token_alignment, token_counts, toxicity, warc
from tickforge.llm.queries import vocabulary

#: Names that operators add or work with, and some that need quoting.
NAMES = [
    "own", "key", "Kept", "n_words", "distance", "group_rows", "group_level", "n_lines", "n_dropped", "copy", "n_copies", "shuffle_key", "ids",
    "round_trip", "__text", "__i", "__key", "__salt", "x0", "s", "id", "hash", "label", "size", "shard", "slot", "a.b", "with space", "tick`ed", "page_id", "url", "media", "__hash", "__keeper", "__page", "__own",
    "score", "terms", "n", "pairs", "fold", "row", "item",
]
TEXT = "one two three four five six seven eight nine ten " * 2 + "\nThis line is long enough to be a key of its own here"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, "other words under the same id", "en", None), (2, TEXT.upper(), None, "a"), (None, TEXT, "en", "b"),
            (None, None, None, None), (3, None, "de", "b"), (4, "", "de", "b"), (5, " \n\t ", "de", "b"), (6, "tie", "en", "a"), (7, "tie", "en", "a"), (8, "w " * 60_000, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in NAMES if c not in df.columns}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))


BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: name -> (operator, whether other columns pass through, the columns that it adds)
OPERATORS = {
    "token_counts": (lambda d: token_counts.token_counts(d, vocabulary(BPE)), False, []),
    "substring_dedup": (lambda d: substring_dedup.substring_dedup(d, 5), False, []),
    "mix_sources": (mixing.mix_sources, True, mixing.ADDED),
    "text_media": (mpeg.text_media, False, []),
    "encode_pieces": (lambda d: pieces.encode_pieces(d, vocabulary(PIECES), check_col="round_trip"), True, ["ids", "round_trip"]),
    "round_trip": (lambda d: pieces.round_trip(d, vocabulary(PIECES)), False, []),
    "archive_pages": (lambda d: warc.archive_pages(d.drop("page_id", "url").withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))), False, []),
    "quality": (quality.quality, True, quality.ADDED),
    "near_components": (ngram_join.near_components, False, []),
    "line_dedup": (lambda d: line_dedup.line_dedup(d, min_docs=2), True, line_dedup.ADDED),
    "align_tokens": (lambda d: token_alignment.align_tokens(d, vocabulary(BPE), vocabulary(PIECES)), False, []),
    "toxicity": (lambda d: toxicity.toxicity(d, toxicity.ToxicityModel({"tie": 3.0}, *toxicity.DEFAULT)), False, []),
    "shard_ring": (lambda d: sharding.shard_ring(d, 3), False, []),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, tmp_path, name):
    work, carries, added = OPERATORS[name]
    work(docs).write.parquet(str(tmp_path / "out"))
    got = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert name == "mix_sources" or got.count() == docs.count()
    if carries:
        low = {c.lower() for c in added}
        kept = [c for c in docs.columns if c.lower() not in low]
        assert got.columns == [*kept, *added]
        assert all(r[c] == f"own {c}" for r in got.collect() for c in kept if c in NAMES)
    assert work(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, tmp_path, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    run(spark, docs, "").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    last = stage == corpus_pipeline.STAGES[-1][0]
    added = {"ids", "round_trip", "n_pieces"} if last else set()
    assert [c for c in got.columns if c not in added] == [c for c in docs.columns if c not in added]
    assert all(r[c] == f"own {c}" for r in got.collect() for c in NAMES if c not in added)
    empty = run(spark, docs.limit(0), "")
    assert empty.count() == 0 and set(empty.columns) == set(got.columns)


def test_near_stage_judges_rows_of_one_id_apart(spark):
    long = " ".join(f"t{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(5, long), (9, long + " more"), (9, other), (None, long + " last"), (None, other + " end"), (12, other), (13, "alone"), (13, "alone"), (14, None), (14, None)]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, df, "").collect()), key=str)
    want = [(None, long + " last"), (None, other + " end"), (13, "alone"), (13, "alone"), (14, None), (14, None)]
    assert got == sorted(want, key=str)


def test_broken_streams_of_every_length():
    data = mpeg.encode(bytes(range(256)) * 12)
    for cut in range(len(data)):
        mpeg.decode(data[:cut])
    # A short frame at the end whose first bytes look like a table.
    head = bytes([0xFF, 0xF3, 0x14, 0xC0])
    size = mpeg.header(head, 0)["length"]
    for mark in (b"Xing", b"Info"):
        for flags in range(8):
            body = (bytes(9) + mark + bytes([0, 0, 0, flags]))[: size - 4]
            assert len(mpeg.decode(head + body + bytes(size - 4 - len(body)))["seek"]) <= 1
            mpeg.decode(head + body)


def test_other_vocabularies_are_refused(spark, tmp_path):
    import json
    from pathlib import Path

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="plain"):
        token_counts.token_counts(df, vocabulary("word_bpe_49k.json"))
    spec = json.loads(Path(vocabulary(BPE)).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_counts.token_counts(df, str(tmp_path / "v.json"))
    proto = Path(vocabulary(PIECES)).read_bytes()
    # A later message of the same field overrides: trainer kind unigram, a normaliser that trims, a user-defined piece.
    for more, why in ((b"\x12\x02\x18\x01", "BPE"), (b"\x1a\x02\x20\x01", "normalises"), (b"\x0a\x07\x0a\x03abc\x18\x04", "user-defined")):
        (tmp_path / "m.model").write_bytes(proto + more)
        with pytest.raises(ValueError, match=why):
            pieces.encode_pieces(df, str(tmp_path / "m.model"))
