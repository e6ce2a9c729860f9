import math
import random
import re

import numpy as np
import pytest

from tickforge.llm import quality as Q
from tickforge.llm.common import WORD

WORDS = re.compile(WORD)


def brute(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    seen, doubles = set(), 0
    for x in lines:
        doubles += x in seen
        seen.add(x)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), doubles, len(covered), len(lines)


def test_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "é# <b> x y", "a b c d e f g h a b c d e f g h", "a " * 40, "l\nl\n l\nl\n\n\n", "x" * 20000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\nq\nq"]) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, None, None) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, lang string, source string")
    for r in Q.quality(df).collect():
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in Q.COUNTS) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def corpus(n=900):
    rng = random.Random(7)
    letters = {"en": 5, "de": 7, None: 4}
    rows = []
    for i in range(n):
        lang = rng.choice([*letters])
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(letters[lang], 1.5)))))  # noqa: B023, E731
        words = [word() for _ in range(int(math.exp(rng.gauss(5, 0.6))) + 20)]
        if i % 9 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, "hot" if i % 3 else f"s{i % 4}"))
    return rows + [(n, None, "en", None), (n + 1, "few words", "en", "hot"), (n, rows[1][1], "en", "hot")]


def concentrated(x, mu, cov, h):
    """Steps to the nearest h rows, ties sharing what is left of h, until the determinant falls no more."""
    floor, last = np.diag(np.square(Q.FLOORS)), math.inf
    for step in range(200):
        d = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)
        m = h[0] if step == 0 else h[1]
        edge = np.sort(d)[m - 1]
        tie = np.isclose(d, edge, rtol=1e-12, atol=0)
        weight = np.where(tie, 0.0, d < edge)
        weight[tie] = (m - weight.sum()) / tie.sum()
        mu = weight @ x / m
        cov = ((x - mu).T * weight) @ (x - mu) / m * (Q.SPREAD if m < len(x) else 1) + floor
        det = np.linalg.slogdet(cov)[1]
        if not det < last - 1e-9:
            break
        last = det if m == h[1] else math.inf
    return np.linalg.slogdet(cov)[1], mu, cov


def starts(x):
    k = (len(x) + 1) // 2 - 1
    floor = np.square(Q.FLOORS)
    mu = np.sort(x, axis=0)[k]
    dev = 1.4826 * np.sort(np.abs(x - mu), axis=0)[k]
    z = (x - mu) / np.sqrt(dev**2 + floor)
    size = np.linalg.norm(z, axis=1, keepdims=True)
    turns = [np.eye(Q.P)]
    for y in (np.tanh(z), np.divide(z, size, out=np.zeros_like(z), where=size > 0)):
        made = np.round(np.einsum("ni,nj->nij", y, y) * Q.UNIT).sum(axis=0) + np.eye(Q.P)
        turns.append(made / np.sqrt(np.outer(np.diag(made), np.diag(made))))
    return [(mu, t * np.outer(dev, dev) + np.diag(floor)) for t in [*turns, np.eye(Q.P)]]


def plain_mcd(x):
    """The same search over one group's whole rows."""
    x = np.floor(np.abs(x * Q.GRID) + 0.5) * np.sign(x) / Q.GRID
    full, half = math.ceil(Q.H * len(x)), math.ceil(0.5 * len(x))
    found = [concentrated(x, mu, cov, (half if s == 3 else full, full)) for s, (mu, cov) in enumerate(starts(x))]
    _, mu, cov = min(found, key=lambda f: f[0])
    return mu, np.linalg.inv(cov)


def vector(counts):
    w, c, s, d, r, n = counts
    x = np.array([math.log(max(w, 1)), math.log(max(c, 1) / max(w, 1)), math.sqrt(s / max(w, 1)), math.sqrt(d / max(n, 1)), math.sqrt(r / max(w, 1))])
    return np.floor(x * Q.GRID + 0.5) / Q.GRID


def test_against_plain_estimates(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = Q.quality(df).collect()
    assert len(got) == len(rows)
    vectors = {}
    for i, t, lang, source in rows:
        own = brute(t)
        vectors[i, t] = (vector(own), lang, source, own[0] < 20 or 100 * own[4] > 30 * own[0])
    good = [v for v in vectors.values() if not v[3]]
    for r in got:
        x, lang, source, failed = vectors[r.doc_id, r.text]
        pick = [v[0] for v in good if (v[1], v[2]) == (lang, source)]
        if len(pick) < Q.MIN_ROWS:
            pick = [v[0] for v in good if v[1] == lang]
        mu, inv = plain_mcd(np.array(pick))
        d = (x - mu) @ inv @ (x - mu)
        assert r.distance == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert r["kept"] == (not failed and d <= Q.CUT)
    kept = {r.doc_id for r in got if r["kept"]}
    assert not kept & set(range(0, 900, 9)) and len(kept) > 790


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a b", "en", "x")], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in Q.quality(df).collect()] == [False, False]
    assert Q.quality(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "one two three four five six seven eight nine ten " * 1 + " ".join(map(str, range(30))), "en", "x")], df.schema)
    assert Q.quality(one).first()["kept"]
    assert Q.chi2_cut(5, 0.95) == pytest.approx(11.0705, abs=1e-3)


def frame(spark, groups):
    """Documents are given as vectors of whole numbers: what with_counts would store."""
    rows = [(f"2={g}", "1=en", False, *map(int, x)) for g, own in groups.items() for x in own]
    return spark.createDataFrame(rows, "key string, lang_key string, base_failed boolean, " + ", ".join(f"{x} long" for x in Q.XS))


def best_of_all(x):
    """The least determinant over all subsets of the rows."""
    from itertools import combinations

    h = math.ceil(Q.H * len(x))
    z = x / Q.GRID
    floor = np.diag(np.square(Q.FLOORS))
    return min(np.linalg.slogdet(np.cov(z[list(s)].T, bias=True) * Q.SPREAD + floor)[1] for s in combinations(range(len(x)), h))


def test_least_determinant_of_all_subsets(spark, monkeypatch):
    monkeypatch.setattr(Q, "MIN_ROWS", 5)
    rng = np.random.default_rng(3)
    groups = {}
    for g in range(10):
        own = rng.normal(0, 60, (12, Q.P)) @ rng.normal(0, 1, (Q.P, Q.P))
        own[:3] += rng.normal(0, 700, Q.P)
        groups[f"g{g}"] = np.round(own)
    found = {}
    for few in (Q.FEW, 0):
        monkeypatch.setattr(Q, "FEW", few)
        found[few] = {r.key[2:]: (list(r.mu), list(r.inv)) for r in Q.fit_groups(frame(spark, groups)).collect()}
    assert found[0] == found[30_000]  # many tasks or one: the same bits
    exact = 0
    for g, x in groups.items():
        det = -np.linalg.slogdet(np.array(found[0][g][1]).reshape(Q.P, Q.P))[1]
        least = best_of_all(x)
        assert det >= least - 1e-9
        exact += det < least + 1e-9
        one = concentrated(x / Q.GRID, *starts(x / Q.GRID)[0], (9, 9))[0]
        assert det <= one + 1e-9
    assert exact >= 9


def test_several_starts_beat_one(spark):
    """A tight cluster of outliers along the clean rows' ridge draws the first start; another finds the clean rows."""
    rng = np.random.default_rng(8)
    better = {}
    for seed in range(40):
        own = rng.normal(0, 40, (150, Q.P)) @ rng.normal(0, 1, (Q.P, Q.P))
        own[:35] = rng.normal(0, 20, (35, Q.P)) + rng.normal(0, 200, Q.P)
        x = np.round(own)
        h = math.ceil(Q.H * len(x))
        dets = [concentrated(x / Q.GRID, mu, cov, (75 if s == 3 else h, h))[0] for s, (mu, cov) in enumerate(starts(x / Q.GRID))]
        if min(dets) < dets[0] - 0.01:
            better[f"g{seed}"] = (x, min(dets))
    assert better
    got = {r.key[2:]: r.inv for r in Q.fit_groups(frame(spark, {g: x for g, (x, _) in better.items()})).collect()}
    for g, (_, least) in better.items():
        assert -np.linalg.slogdet(np.array(got[g]).reshape(Q.P, Q.P))[1] == pytest.approx(least, abs=1e-6)


def test_partitions_change_no_bit(spark):
    df = spark.createDataFrame(corpus(500), "doc_id long, text string, lang string, source string")
    a, b = ({(r.doc_id, r.n_words, r.distance, r["kept"]) for r in Q.quality(d).collect()} for d in (df.repartition(7), df.coalesce(1)))
    assert a == b
