"""Line dedup, mixing and sharding against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tickforge.llm.line_dedup import line_dedup
from tickforge.llm.mixing import mix_sources, source_rates
from tickforge.llm.sharding import capacities, owners, ring, shard_ring

LONG = "this line is long enough to be counted as a key"
SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_chars=40, min_docs=5):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(SPACES))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(low(line)) >= min_chars:
                holders[low(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(low(x), ())) < min_docs or max(holders[low(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [LONG, LONG.upper() + " ", "\t" + LONG, "short", "", "É" * 40, "é" * 40, "x" * 39, LONG + "!"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 7)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n".join([LONG] * 3000)), (None, LONG + "\nb"), (3, rows[3][1]), (3, LONG + "\nc")]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, __pos string, key int")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "__pos", "key", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str)
    assert found == sorted(brute_lines(rows), key=str)
    assert line_dedup(df.limit(0)).count() == 0


def poisson_inverse(rate, u):
    import math

    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark):
    rows = [(i, f"s{min(i % 9, 2)}", "word " * (1 + i % 5)) for i in range(900)] + [(1000, None, "abc"), (1001, "s0", None), (5, "s2", "again"), (None, "s1", "q")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, copy int")
    weights = {"s0": 1, "s1": 3.0, None: 0.01, "absent": 2}
    rates = {r.source: r.mean_rate for r in source_rates(df, weights).collect()}
    assert set(rates) == {"s0", "s1", None}
    got = mix_sources(df, weights).collect()
    assert got == sorted(got, key=lambda r: (r.shuffle_key, r.doc_id or 0, r.copy))
    want = Counter()
    for i, s, t in rows:
        if s in rates:
            u = int(hashlib.md5(f"mix-1|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            want[i, s, t] += poisson_inverse(rates[s], u)
    assert Counter((r.doc_id, r.source, r.text) for r in got) == +want
    size = Counter()
    for r in got:
        size[r.source] += len((r.text or "").encode())
    assert 2.4 < size["s1"] / size["s0"] < 3.6
    assert mix_sources(df.limit(0)).count() == 0
    assert mix_sources(df.where("text is null")).count() == 0


def test_large_rate_has_no_cap(spark):
    df = spark.createDataFrame([(i, "a", "x") for i in range(40)] + [(99, "b", "x" * 40000)], "doc_id long, source string, text string")
    n = mix_sources(df, {"a": 1.0, "b": 1.0}).where("source = 'a'").count()
    assert abs(n - 20020) < 600


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ring(spark, slack):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7)) for i in range(1003)] + [(None, "n"), (4, "again"), (4, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    got = shard_ring(df, 8, slack).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = [len(shards[s]) for s in range(8)]
    if slack:
        assert max(sizes) <= capacities(len(rows), 8, slack)[0]
    else:
        assert max(sizes) - min(sizes) <= 1
    # one row after another, by rounds
    bits = lambda name, i: int(hashlib.md5(f"{name}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16)
    room, rest, want = capacities(len(rows), 8, slack), sorted((bits("ring-order", i), i or -1, i) for i, _ in rows), Counter()
    while rest:
        table, later = owners(ring(8), {s for s in range(8) if room[s] > 0}), []
        for x in rest:
            s = table[bits("ring-place", x[2]) % 4096]
            if room[s] > 0:
                room[s] -= 1
                want[x[2], s] += 1
            else:
                later.append(x)
        rest = later
    assert Counter((r.doc_id, r.shard) for r in got) == want
    assert shard_ring(df.limit(0)).count() == 0


def test_exact_shards_move_more(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text")
    a, b = ({r.doc_id: r.shard for r in shard_ring(df, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.65 * 2000


def test_ring_moves_little(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text")
    a, b = ({r.doc_id: r.shard for r in shard_ring(df, n, 0.25).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.35 * 2000
