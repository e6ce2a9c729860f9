import random
import re

import pytest

from tickforge.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < key(i):
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}é" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (6, 12, 30, 5, 7)]
    rows = []
    for i in range(120):
        w = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + text(rng.randint(0, 4))
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(20_000, rows[0][1]), (20_001, rows[0][1]), (3, None), (4, ""), (5, " \n"), (None, " ".join(shared[2])), (6, "a " * 3000), (7, "a " * 40), (7, " ".join(shared[1])), (7, " ".join(shared[1]) + " x")]
    return rows


@pytest.mark.parametrize("tiny", [False, True])
def test_against_plain(spark, tiny, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    if tiny:
        monkeypatch.setattr(S, "NARROW_ROWS", 0)
    for k in (5, 8):
        got = S.substring_dedup(df, k).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, k)
        for r in got:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert S.substring_dedup(df.limit(0), 5).count() == 0


def test_slices_meet(spark, monkeypatch):
    """Slices of one text each: what is known inside a slice and what is asked give the same."""
    from tickforge.llm import words

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(df, 6).collect()), key=str) == brute(rows, 6)
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(one, 6).collect()), key=str) == brute(rows, 6)
    assert words.SLICE_BYTES > 0


def test_rolling():
    import numpy as np

    v = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    h = S.rolling(v, S.BASE, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4


def test_sorted_pass_carries_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(8), rng.choice([-2, 0, 1]), rng.randrange(20)) for _ in range(300))
    least = {}
    for h, b, i in rows:
        least.setdefault((h, b), i)
    want = [(i, h) for h, b, i in rows if b < 0 or i > least[h, b]]
    for size in (1, 3, 50, 300):
        parts = [rows[a : a + size] for a in range(0, 300, size)]
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[1] for r in p], pa.int32()), pa.array([r[2] for r in p]), pa.array([r[0] for r in p])], ["bucket", "id", "hash"])
            for p in parts
        ]
        got = [(r["id"], r["hash"]) for b in S.later_ones(iter(batches)) for r in b.to_pylist()]
        assert got == want and np.int64(len(got)) > 0
