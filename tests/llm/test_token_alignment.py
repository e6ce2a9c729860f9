"""Alignment against whole texts by the tokenizers' own libraries and a plain merge of byte ranges."""

import hashlib
import random
from collections import Counter

import pytest

from tickforge.llm import queries, token_alignment
from tickforge.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", " \n x", "Hello world's 12345 don't", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café 日本語 🎉🎉 ñandú",
    "x▁y", "▁", "x" * 3000, " " * 500, "ab" * 900 + "\u0000\x07", "lowest  newer\r\n\ttab", "ÀÉ́ é", "a  b　 c  d é é ɏ x", "tie", "tie", "a\x1c b \x85 c",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


def tokens(text, libraries):
    """[(id, bytes)] on both sides, or None."""
    a, b = libraries
    if not text:
        return None
    from tickforge.llm.token_counts import byte_names

    names = byte_names()
    left = [(i, bytes(names[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (left, right))
    return (left, right) if same else None


def brute(texts, libraries):
    """One row a text: the contract's columns, by byte ranges."""
    found, corpus = [], Counter()
    for text in texts:
        both = tokens(text, libraries)
        if both is None:
            found.append(None)
            continue
        spans = []
        for side in both:
            at, own = 0, []
            for i, raw in side:
                own.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(own)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        told, start = [], 0
        for stop in common:
            told.append("|".join(",".join(str(i) for a, b, i in own if start <= a and b <= stop) for own in spans))
            start = stop
        links, j = [], 0
        for a, b, i in spans[0]:
            while spans[1][j][1] <= a:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < b:
                links.append((i, spans[1][k][2]))
                k += 1
        corpus.update(links)
        found.append((len(spans[0]), len(spans[1]), len(common), links, hashlib.sha256(";".join(told).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(corpus[p] == top[p[1]] for p in f[3]), sum(corpus[p] for p in f[3]), f[4]) for f in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("pairs", [token_alignment.PAIRS, 150])
def test_odd_and_random_texts(spark, libraries, pairs):
    rng = random.Random(5)
    signs = "abcdeé \n.,'0日s<|>   ñ-ÿ▁"
    texts = TEXTS + ["".join(rng.choice(signs[: rng.choice((12, 27, 28))]) for _ in range(rng.randint(1, 200))) for _ in range(250)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.align_tokens(df, vocabulary(A), vocabulary(B), pairs=pairs).collect()}
    assert got == dict(enumerate(brute(texts, libraries)))


def test_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, folder).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], libraries), strict=True))


def test_rows_without_ids_and_no_rows(spark, libraries):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two"), (3, None)], "doc_id long, text string")
    got = token_alignment.align_tokens(df, vocabulary(A), vocabulary(B)).collect()
    want = brute(["one two"] * 3 + [None], libraries)
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(i), *w) for i, w in zip([None, None, 3, 3], want, strict=True))
    assert token_alignment.align_tokens(df.limit(0), vocabulary(A), vocabulary(B)).count() == 0


def test_runs_and_groups():
    runs, link_a, link_b, group_a, group_b = token_alignment.align([1, 2, 3, 5, 7, 8, 9, 10, 11, 12], [1, 2, 3, 6, 7, 8, 9, 10, 12])
    assert runs == [(0, 0, 3), (5, 5, 3)]
    assert list(zip(link_a, link_b, strict=True)) == [(3, 3), (4, 3), (4, 4), (8, 8), (9, 8)] and group_a == [3, 8] and group_b == [3, 8]
    assert token_alignment.align([], []) == ([], [], [], [], [])


def test_other_vocabularies_are_refused():
    import json
    from pathlib import Path

    spec = json.loads(Path(vocabulary(A)).read_text())
    merges = spec["model"]["merges"]
    for change in (merges[1:] + merges[:1], merges[:-1]):
        with pytest.raises(ValueError):
            token_alignment.refuse_unreachable(json.dumps(spec | {"model": spec["model"] | {"merges": change}}).encode())
