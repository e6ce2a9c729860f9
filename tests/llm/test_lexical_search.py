"""Searches against a plain scoring of every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tickforge.llm import lexical_search as search


def plain(docs, items, k=10):
    own = [(i, Counter(search.terms_of(t)), len(search.terms_of(t))) for i, t in docs]
    own = [d for d in own if d[2]]
    total, length = len(own), sum(d[2] for d in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        rows = []
        for i, tf, n in own:
            m = 25 + 75 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in search.terms_of(text) if t in tf
            )
            if score > 0:
                rows.append((i, score))
        rows.sort(key=lambda r: (-r[1], -math.inf if r[0] is None else r[0]))
        out += [(item, rank, i, score) for rank, (i, score) in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, **more):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.lexical_search(*frames(spark, docs, items), **more).collect()), key=str)


ODD = [
    (None, None), (1, ""), (2, " \n-_!"), (3, "Alpha BETA alpha"), (4, "alpha-beta_gamma"), (4, "alpha"), (None, "beta gamma"), (5, "ÀÉ àé Ünïcode 日本"), (6, "ünïcode"),
    (7, "alpha " * 30_000), (8, "tie one"), (9, "tie one"), (10, "tie one"), (11, "x\x7fy\x00z"), (12, "\xa0alpha beta"),
]
ASKED = [(1, "alpha"), (2, "ALPHA beta alpha alpha"), (3, None), (4, " - "), (5, "Ünïcode ünïcode àé"), (6, "tie"), (7, "y z none"), (7, "y z none"), (7, "gamma"), (None, "one two")]


def test_odd_texts(spark):
    assert found(spark, ODD, ASKED) == plain(ODD, ASKED)
    assert found(spark, ODD, ASKED, k=2) == plain(ODD, ASKED, 2)
    assert found(spark, [], ASKED) == [] and found(spark, ODD, []) == []


@pytest.mark.parametrize("small", [False, True])
def test_random_texts_in_small_trees_and_blocks(spark, monkeypatch, small):
    if small:
        for name, value in (("TREE_DOCS", 7), ("TREE_ENTRIES", 60), ("BLOCK_ITEMS", 4), ("FEW", 1)):
            monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((5, 20, 40))]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # copies
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    assert found(spark, docs, items) == plain(docs, items)


def test_bounds_prune():
    """Trees of look-alikes are left early; the best are the same as of every vector."""
    rng = np.random.default_rng(3)
    width, docs = 60, []
    for i in range(400):
        terms = np.sort(rng.choice(width, rng.integers(1, 20), replace=False))
        docs.append((i, int(rng.integers(25, 400)), terms, rng.integers(1, 6, len(terms)).astype(np.int32)))
    tree = search.Tree(*map(list, zip(*docs, strict=True)), 3)
    weights = (width - np.arange(width)) ** 2 * 10  # rare terms weigh most
    picks = [np.sort(rng.choice(20, 4, replace=False)) for _ in range(5)]
    best = search.Best(5, 3)
    seen = tree.search(search.Items(picks, [weights[p] for p in picks], width), best)
    for pick, rows in zip(picks, best.rows, strict=True):
        scores = []
        for i, m, terms, tfs in docs:
            tf = dict(zip(terms.tolist(), tfs.tolist(), strict=True))
            scores.append((-sum(int(weights[t]) * int(search.part_score(np.int64(tf[t]), m)) for t in pick.tolist() if t in tf), i))
        assert rows == [(-s, i) for s, i in sorted(scores)[:3] if s]
    assert seen < 2 * len(docs)
