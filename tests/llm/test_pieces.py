import random

import numpy as np
import pyarrow as pa
import pytest

from tickforge.llm import pieces as P
from tickforge.llm.queries import vocabulary

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


def texts():
    rng = random.Random(4)
    rows = [None, "", " ", "  ", "a", " a", "a ", "Hello  world", "tab\tand\nline\r\n\nend", "naïve café 日本語 🎉", "x" * 6000, " " * 3000, "<s>hi</s><unk><0x0A>", "\x07 ﬁ ½", "áé"]
    rows += ["".join(rng.choice("abcdethin   \n.,'é日<0x>") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return rows


def test_same_as_library(spark, library):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(None, "b c", "y"), (5, "dup", "y")], "doc_id long, text string, ids string")
    got = P.round_trip(df, vocabulary(MODEL)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        t = "b c" if r.doc_id is None else rows[r.doc_id] or ""
        if r.doc_id == 5 and r.ids == library.encode("dup"):
            continue
        assert r.ids == library.encode(t) and r.n_pieces == len(r.ids), t
        assert r.round_trip, t
    assert P.round_trip(df.limit(0), vocabulary(MODEL)).count() == 0
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert not P.round_trip(marked, vocabulary(MODEL)).first().round_trip


def test_real_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = P.encode_pieces(docs, vocabulary(MODEL))
    assert made.columns == [*docs.columns, "ids"]
    for r in made.collect():
        assert r.ids == library.encode(r.text)


def test_decode_and_table_bound(spark, library, monkeypatch):
    decode = P.decode_pieces(spark, vocabulary(MODEL))
    rng = random.Random(6)
    rows = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>").select("ids", decode("ids").alias("t"))
    known = [i for i in range(32000) if not library.is_byte(i)]
    assert sum(r.t == library.decode(r.ids) for r in df.collect() if all(i in known for i in r.ids)) > 50
    monkeypatch.setattr(P, "KEPT", 4)
    from pathlib import Path

    import pyarrow as pa

    model = P.Model(Path(vocabulary(MODEL)).read_bytes())
    for t in ("one two three four", "five six seven", "one " * 30):
        assert model.encode(pa.array([t])).to_pylist() == [library.encode(t)] and len(model.index) <= 4
    with pytest.raises(ValueError):
        model.decode(pa.array([[32000]], pa.list_(pa.int32())))


def test_both_relaxations(library, monkeypatch):
    from pathlib import Path

    import pyarrow as pa

    for short in (0, 3, 10_000):
        monkeypatch.setattr(P, "SHORT", short)
        monkeypatch.setattr(P, "INDEXED", 100)
        model = P.Model(Path(vocabulary(MODEL)).read_bytes())
        for t in texts()[1:80]:
            if len(t) < 400:
                assert model.encode(pa.array([t])).to_pylist() == [library.encode(t)]


def test_suffix_array():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 200)
    order = P.suffix_array(text, 8)
    heads = [tuple(text[i : i + 8]) for i in order]
    assert heads == sorted(heads)
    want = [(0, 1), (2, 2), (1, 0)]
    low, high = P.occurrences(text, order, np.array(want), np.array([2, 2, 2]))
    for w, a, b in zip(want, low, high, strict=True):
        assert sorted(order[a:b]) == [i for i in range(199) if tuple(text[i : i + 2]) == w]


def test_unbroken_texts(monkeypatch):
    """Units longer than what is indexed at once, cut anywhere, and a text of a million characters without a space."""
    from pathlib import Path

    import sentencepiece

    proto = Path(vocabulary(MODEL)).read_bytes()
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), P.Model(proto)
    rng = random.Random(2)
    long = "".join(rng.choice(["the", "ing", "er", "a", "é", "日", "x", "0"]) for _ in range(400_000))
    assert model.encode(pa.array([long]))[0].as_py() == library.encode(long)
    for size in (7, 40, 300):
        monkeypatch.setattr(P, "INDEXED", size)
        texts = ["".join(rng.choice("theringaon\u00e9日") for _ in range(rng.randint(1, 700))) for _ in range(20)] + ["a" * 500, "▁" * 90]
        model = P.Model(proto)
        assert [x.as_py() for x in model.encode(pa.array(texts))] == library.encode(texts)


def test_many_symbols_are_compared_at_once(monkeypatch):
    """Suffixes of words are sorted in two steps, not one for each doubling from a single symbol; found are all places of pieces of any length."""
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(P.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 100, 3000), rng.integers(97, 160, 3000)])
    order = P.suffix_array(text, 16)
    assert len(sorts) <= 3
    heads = [tuple(text[i : i + 16]) for i in order]
    assert heads == sorted(heads)
    whole = text.tolist()
    want = [whole[a : a + n] for n in range(1, 17) for a in rng.integers(0, 5980, 20).tolist()] + [whole[-n:] for n in range(1, 17)] + [[97, 500], [99, 97, 5], whole[-3:] + [700]]
    rows = np.full((len(want), 16), -1)
    for i, w in enumerate(want):
        rows[i, : len(w)] = w
    low, high = P.occurrences(text, order, rows, np.array([len(w) for w in want]))
    for w, a, b in zip(want, low, high, strict=True):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(whole) - len(w) + 1) if whole[i : i + len(w)] == w]


def test_units_tile_the_texts():
    import re
    from pathlib import Path

    model = P.Model(Path(vocabulary(MODEL)).read_bytes())
    rows = [*texts(), "\n", "a\n b\n\n  c", "▁▁x y"]
    for part in (pa.array(rows), pa.array(["skipped", *rows])[1:], pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        units, counts = model.units(part)
        line = "\n|" * model.line
        told = [re.findall(f"{line}▁+[^▁{line[:1]}]*|[^▁{line[:1]}]+", ("▁" + t).replace(" ", "▁")) if t else [] for t in part.to_pylist()]
        assert [u.replace(" ", "▁") for u in units.to_pylist()] == [u for t in told for u in t] and counts.tolist() == [len(t) for t in told]
