import random
import re
from fractions import Fraction

import pytest

from tickforge.llm.components import components
from tickforge.llm.ngram_join import near_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k, limit):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * limit.denominator >= len(a | b) * limit.numerator:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 62), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(2, 160))] for _ in range(60)]
    rows = []
    for b in base[:25]:
        for _ in range(rng.randint(1, 9)):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            if rng.random() < 0.3:
                c = c[: max(1, len(c) - rng.randint(0, 12))]
            rows.append(" ".join(c).title() if rng.random() < 0.2 else "\n".join(c))
    rows += [" ".join(b) for b in base[25:]] + ["a", "A", "a b", "a  b", "É", "é", "", None, " \t", "a b c", "a b c d"] * 2
    rows += [" ".join(["x"] * 500), " ".join(["x"] * 900), " ".join(vocab * 20)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "limit"), [(3, "0.9"), (5, "0.8"), (2, "0.5")])
def test_against_all_pairs(spark, k, limit):
    rows = corpus(k)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(tuple(r) for r in near_components(df, k, limit).collect())
    assert got == brute(rows, k, Fraction(limit))


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(50))
    rows = [(None, long), (4, long), (4, long), (9, "one two three"), (9, "four five six"), (11, "four five six"), (12, "one two three"), (13, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_components(df, 3, "0.9").collect()}
    assert {(None, 48, None), (4, 48, None), (13, 0, 13)} <= got
    assert len({r for r in got if r[0] in (9, 11, 12)}) == 3 and {r[2] for r in got if r[0] == 9} == {9}
    assert near_components(df.limit(0), 3, "0.9").count() == 0
    assert near_components(df.where("doc_id = 13"), 3, "0.9").count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 100), (5, 5), (7, 6)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[300] == 100 and got[1199] == 1000 and 5 in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_large_sides_and_short_blocks(spark, monkeypatch):
    """Nothing is broadcast, and lists are cut into blocks of three: the same components."""
    from tickforge.llm import components as module
    from tickforge.llm import ngram_join

    for m, n in ((ngram_join, "NARROW_ROWS"), (module, "NARROW_ROWS")):
        monkeypatch.setattr(m, n, -1)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "COMBINED", 2)
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = corpus(9) + [(2000 + i, shared + " " + " ".join(f"o{i}-{j}" for j in range(rng.randint(6, 14)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_components(df, 3, "0.9").collect())
    assert got == brute(rows, 3, Fraction("0.9"))


def test_shorter_prefix_loses_no_pair(spark):
    from pyspark.sql import functions as F

    from tickforge.llm.ngram_join import band, needed, shorter_prefix

    for limit in map(Fraction, ("0.5", "0.8", "0.9", "1")):
        df = spark.range(1, 400).withColumnRenamed("id", "a").join(spark.range(1, 400).withColumnRenamed("id", "b"), F.col("b").between(F.col("a"), F.ceil(F.col("a") / float(limit))))
        n, m = F.col("a"), F.col("b")
        row = df.select(n, m, needed(limit, n, m).alias("need"), shorter_prefix(limit, n).alias("short"), band(limit, n).alias("u"), band(limit, m).alias("v")).collect()
        for r in row:
            o = next(o for o in range(r.a + r.b + 1) if o * limit.denominator >= limit.numerator * (r.a + r.b - o))
            assert r.need == o
            if o <= r.a:  # a shared shingle is among the first a - o + 1
                assert r.short >= r.a - o + 1 and abs(r.u - r.v) <= 1


def test_a_long_list_of_unlike_nodes(spark):
    """10,000 nodes of one list, all of different labels: 60 have the token in their shorter prefix, and only these are compared."""
    from pyspark.sql import functions as F

    from tickforge.llm.ngram_join import SKETCH, between_labels, meetings

    size, limit = 10_000, Fraction("0.8")
    held = spark.range(size).select(
        F.lit(7).cast("long").alias("token"), "id", F.lit(100).alias("n"), F.when(F.col("id") % 167 == 0, 3).otherwise(15).cast("int").alias("pos"),
        F.col("id").alias("label"), F.lit(0).cast("long").alias("main"),
    )
    sketches = spark.range(size).select("id", F.array_repeat(F.lit(0).cast("long"), SKETCH).alias("sketch"))
    probes = size // 167 + 1
    assert meetings(held, sketches, limit).count() == (probes - 1) * size + (size - 1)
    # Of equal sets of 100, place 15 leaves too few shingles for the 89 that are needed: only the probes' pairs pass.
    assert between_labels(held, sketches, limit).count() == probes * (probes - 1) // 2
