"""Helpers: both ways of the counted join, words and slices, stored tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickforge.llm import common, words
from tickforge.operators import joins
from tickforge.sources import scratch


@pytest.mark.parametrize("rows", [0, 50_000])
def test_with_small(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    left = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)] + [(99, "none")], "id long, k string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    got = sorted((r.id, r.k, r.v) for r in common.with_small(left, right, "k", salts=4).collect())
    assert got == sorted([(i, "a", 1) if i % 2 else (i, None, 2) for i in range(40)] + [(99, "none", None)], key=lambda r: r[0])


def test_stored_in_the_shared_folder(spark):
    df = common.stored(spark.range(5), "probe")
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(scratch.base_dir(spark))


def test_split_and_shingles():
    rng = random.Random(0)
    texts = [None, "", " \x0b\x0c", "A b", "é"] + ["".join(rng.choice("abC \n\t\r\x0b é") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    codes, distinct, starts = words.split(pa.array(texts))
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        assert [names[c] for c in codes[starts[i] : starts[i + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for k in (1, 3):
        owner, hashes = words.shingles(*words.split(pa.array(texts), lower=True), k)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            want = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
            assert int((owner == i).sum()) == len(want)
        assert (np.diff(owner) >= 0).all()


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (0, 5, 99, 1, 0, 40, 40, 3, 200)])], ["i", "t"])
    for most in (1, 50, 10_000):
        parts = list(words.slices(iter([batch, batch.slice(0, 0)]), 1, most))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9))
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= most for p in parts)
