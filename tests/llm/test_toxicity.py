"""The grammar clause by clause, its features against plain Python, and learning from labels."""

import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from tickforge.llm import queries, toxicity
from tickforge.llm.toxicity import GRAMMAR, Reader, ToxicityModel, fit_toxicity


@pytest.mark.parametrize(
    ("classes", "kinds"),
    [("O", "I"), ("TO", "TA"), ("OT", "AT"), ("OTO", "ATA"), ("NO", "Nn"), ("ON", "IN"), ("RO", "Rr"), ("RNO", "RNr"), ("H", "."), ("HT", "DT"), ("TH", "TD"), ("TNH", "TNn"), ("ONT", "ANT"), ("", "")],
)
def test_grammar(classes, kinds):
    assert GRAMMAR.best(classes) == kinds


def plain(text, lexicon):
    """(sums by feature, matched clauses) of a text, one clause after another."""
    sums, clauses, n = [0.0] * 4, 0, 0
    clause = []
    tokens = (text or "").split()
    for at, token in enumerate(tokens):
        n += 1
        found = None
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", token.lower()):
            own = max([lexicon.get(w, 0)] + [lexicon.get(w[:k] + "-", 0) for k in range(4, 8) if len(w) > k])
            if own >= toxicity.LEAST and (found is None or found[0] != "O" or own > found[1]):
                found = ("O", own)
            elif found is None:
                for sign, words in (("H", toxicity.THREATS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("T", toxicity.TARGETS)):
                    if w in words:
                        found = (sign, toxicity.THREAT)
                        break
        if found:
            clause.append(found)
        if token[-1] in ".!?;:" or at == len(tokens) - 1:
            aimed, denied, told, some = any(s == "T" for s, _ in clause), False, False, False
            for sign, weight in clause:
                denied, told = denied or sign == "N", told or sign == "R"
                if sign == "O" or (sign == "H" and aimed):
                    sums[3 if told else 2 if denied else 1 if aimed else 0] += weight
                    some = True
            clauses += some
            clause = []
    return [math.log1p(s) for s in sums] + [math.log1p(200 * (sums[0] + sums[1]) / (n + 20))], clauses


def test_features_of_random_texts():
    rng = random.Random(1)
    words = ["you", "no", "said", "kill", "fool", "fools", "foolish,", "plain", "words", "it.", "scum!", "they", "not", "kill.", "x;y", "fool-you", "dice", "scum", "K1LL", "FOOL"]
    lexicon = {"fool": 4.0, "fool-": 2.5, "scum": 6.0, "words": 0.5}
    texts = [None, "", " \n", "fool", "w " * 5000 + "fool " * 5000] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    found, matched = Reader(lexicon).features(pa.array(texts))
    for text, row, n in zip(texts, found, matched, strict=True):
        want, clauses = plain(text, lexicon)
        assert row == pytest.approx(want) and n == clauses


def corpus(rng, n, stems=("zorgl", "quibb")):
    """Toxic rows hold inflected forms of the stems."""
    fill = ["".join(rng.choice("abcdeklmnou") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(fill) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["a", "en", "ish", "oso"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_inflected_insults(spark):
    rows = corpus(random.Random(7), 800)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, "x", "s"), (801, None, "s")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert {"zorgl-", "quibb-"} <= set(model.lexicon) and all(w.startswith(("zorg", "quib")) for w in model.lexicon)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == 802 and got[None] == got[801] < 0.5
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    # What the held-out rows are labelled teaches nothing.
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    again = fit_toxicity(docs, flipped)
    assert again.lexicon == model.lexicon and again.coefficients == pytest.approx(model.coefficients)


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = fit_toxicity(docs, some)
        assert model == ToxicityModel({}, *toxicity.DEFAULT)
        assert {r.doc_id for r in toxicity.toxicity(docs, model).collect()} == {1, 2}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()
    assert set(got) == {r.doc_id for r in docs} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scores = [[got[i].score for i, y in labels.items() if y == k and got[i].held_out] for k in (0, 1)]
    above = sum((a > b) + (a == b) / 2 for a in scores[1] for b in scores[0]) / (len(scores[0]) * len(scores[1]))
    assert above > 0.93
