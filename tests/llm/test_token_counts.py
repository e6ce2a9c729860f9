import random

import pytest

from tickforge.llm.queries import vocabulary
from tickforge.llm.token_counts import Counter, merge_count, token_counts

TEXTS = [
    None, "", " ", "\n\n  a", "Hello world's 12345 don't", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "naïve café 日本語 🎉🎉",
    "x" * 30000, " " * 5000, "ab" * 9000 + "\u0000\x07", "lowest  newer\r\n\ttab", "<|endoftext|>" * 50, "ÀÉ́ é",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_token_counts(spark, library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdeé \n.,'0日s<|>") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 2), (3, "dup", 2)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes): r for r in token_counts(df, vocabulary("byte_bpe_50k.json")).collect()}
    for i, t in [*enumerate(texts), (None, "a b"), (3, "dup")]:
        r = got[i, len((t or "").encode())]
        assert r.n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_merge_order_and_table_bound():
    ranks = {(b"a", b"b"): 1, (b"b", b"a"): 0, (b"ba", b"b"): 2}
    assert merge_count([b"a", b"b", b"a", b"b"], ranks) == 2  # a bab
    assert merge_count([b"a"], ranks) == 1
    from pathlib import Path

    from tickforge.llm import token_counts as module

    kept, module.KEPT = module.KEPT, 3
    try:
        c = Counter(Path(vocabulary("byte_bpe_50k.json")).read_bytes())
        assert c.tokens("one two three four five six") == 6 and len(c) <= 3
    finally:
        module.KEPT = kept


def test_real_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
