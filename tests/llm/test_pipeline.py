"""The whole pipeline against plain Python on a small corpus."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np

import corpus_pipeline
from tests.llm.test_native import brute_lines, poisson_inverse
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_quality import plain_mcd, vector
from tickforge.llm import quality as Q
from tickforge.llm.queries import vocabulary


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 14)))
    notice = "Copyright of nobody: this line stands in many of the documents."
    rows = []
    for i in range(330):
        lines = [line() for _ in range(rng.randint(3, 12))]
        if i % 6 == 0:
            lines.insert(rng.randint(0, 3), notice)
        if i % 15 == 0:
            lines = [" ".join(w + "$$$" for w in x.split()) for x in lines]
        if i % 10 == 7:
            words = rows[-3][1].split(" ")
            words[len(words) // 2] = "changed"
            lines = " ".join(words).split("\n")
        rows.append((i, "\n".join(lines), "en" if i % 3 else "de", f"src{min(i % 7, 2)}"))
    return rows + [(400, None, "en", "src0"), (401, "short", None, None), (402, rows[1][1], "en", "src1")]


def plain(rows):
    stats = {i: brute_counts(t) for i, t, _, _ in rows}

    failed = {i: v[0] < 20 or 100 * v[4] > 30 * v[0] for i, v in stats.items()}
    estimates = {}

    def estimate(lang, source):
        if (lang, source) not in estimates:
            for pick in ([r for r in rows if r[2:] == (lang, source)], [r for r in rows if r[2] == lang], rows):
                good = [vector(stats[r[0]]) for r in pick if not failed[r[0]]]
                if len(good) >= Q.MIN_ROWS:
                    break
            estimates[lang, source] = plain_mcd(np.array(good))
        return estimates[lang, source]

    kept = []
    for i, t, lang, source in rows:
        mu, inv = estimate(lang, source)
        x = vector(stats[i]) - mu
        if not failed[i] and x @ inv @ x <= Q.CUT:
            kept.append((i, t, lang, source))
    texts = {i: t for i, _, _, t in brute_lines([r[:2] for r in kept])}
    comp = {i: c for i, _, c in brute_components(list(texts.items()), 5, Fraction("0.8"))}
    left = [(i, texts[i], s) for i, _, _, s in kept if comp[i] == i]
    size = Counter()
    for _, t, s in left:
        size[s] += len(t.encode())
    out = Counter()
    for i, t, s in left:
        rate = 1 / len(size) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i, t] += poisson_inverse(rate, u)
    return +out, len(kept), len(left)


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rows = corpus()
    frame = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, kept, left = plain(rows)
    assert kept < len(rows) - 20 and left < kept - 10
    assert Counter((r.doc_id, r.text) for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(corpus_pipeline.MODEL))
    assert all(r.ids == library.encode(r.text) and r.round_trip and r.n_chars == len(r.text) for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
