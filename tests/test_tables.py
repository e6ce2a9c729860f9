"""Stored tables: few files, packed partitions, and streams that break off."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import indicators, ingest, model, tables
from tickforge.sources import candles as C
from tickforge.sources.scratch import once
from tickforge.streaming import candles as streams

SCHEMA = "symbol string, open_time_ms long, close double, arrival long"
MINUTE, DAY = 60_000, 86_400_000


def table(spark, tmp_path, name="t"):
    name = f"{name}_{tmp_path.name}"
    ingest.create_if_absent(spark, name)
    return name


def rows_of(df):
    return sorted((r.symbol, r.open_time_ms, r.close) for r in df.collect())


def test_files_follow_buckets_and_months_not_symbols(spark, tmp_path):
    name = table(spark, tmp_path)
    rows = spark.range(60_000).selectExpr("concat('s', id % 1000) AS symbol", f"(id DIV 1000) * {DAY // 2} AS open_time_ms", "double(id) AS close", "id AS arrival")
    for k in range(6):
        ingest.append_new(name, rows.where(f"arrival DIV 1000 % 6 = {k}"), ["arrival"])
    before = spark.table(name)
    want, many = rows_of(before), len(before.inputFiles())
    left = tables.compact(spark, name)
    after = spark.table(name)
    assert len(after.inputFiles()) == after.select(*tables.KEYS).distinct().count() <= tables.BUCKETS * 2 < many
    assert rows_of(after) == want and len(want) == 60_000
    assert rows_of(before) == want  # a reader from before still has its files
    tables.drop(spark, left)
    assert rows_of(spark.table(name)) == want
    assert tables.compact(spark, name) == []
    # The packed table takes more rows, and can be emptied.
    assert ingest.append_new(name, rows.limit(100), ["arrival"]).count() == 0
    more = spark.createDataFrame([("s1", 5 * MINUTE, 1.0, 1), ("new", 400 * DAY, 2.0, 1)], SCHEMA)
    assert ingest.append_new(name, more, ["arrival"]).count() == 2 and spark.table(name).count() == 60_002
    ingest.reset(spark, name)
    assert spark.table(name).count() == 0
    assert ingest.append_new(name, more, ["arrival"]).count() == 2 and spark.table(name).count() == 2


def test_replaced_partitions(spark, tmp_path):
    name = table(spark, tmp_path)
    rows = spark.createDataFrame([(s, d * DAY, float(d), 0) for s in "ABC" for d in (0, 10, 40)], SCHEMA)
    ingest.append_new(name, rows, ["arrival"])
    changed = spark.table(name).where("symbol = 'A' AND open_month = '1970-01'").withColumn("close", F.col("close") + 100)
    (key,) = tables.partitions(changed)
    others = tables.in_partitions(spark.table(name), [key]).where("symbol <> 'A'")
    tables.replace(changed.unionByName(others), name)
    assert rows_of(spark.table(name)) == sorted((s, d * DAY, d + (100.0 if s == "A" and d < 31 else 0)) for s in "ABC" for d in (0, 10, 40))


@pytest.mark.parametrize("strict", [False, True])
def test_a_batch_that_broke_off_while_appending(spark, tmp_path, strict):
    """Only the file of the newest row had been moved; the replay brings the others, and reports what the first try would have."""
    name = table(spark, tmp_path)
    first = spark.createDataFrame([("A", 0, 1.0, 1)], SCHEMA)
    streams.ingest_batch(first, 0, name, f"{tmp_path}/f", ["arrival"], strict)
    batch = spark.createDataFrame([("A", 0, 9.0, 2), ("A", MINUTE, 2.0, 3), ("A", 40 * DAY, 3.0, 4), ("A", 80 * DAY, 4.0, 5)], SCHEMA)
    work = lambda: streams.ingest_batch(batch, 1, name, f"{tmp_path}/f", ["arrival"], strict, f"{tmp_path}/r")
    append, moved = tables.append, []

    def broken(rows, target):
        append(rows.where(f"open_time_ms = {80 * DAY}"), target)
        moved.append(1)
        raise RuntimeError("lost")

    tables.append = broken
    try:
        with pytest.raises(RuntimeError):
            work()
    finally:
        tables.append = append
    assert moved and spark.table(name).count() == 2
    want = [("A", 0, 1.0), ("A", MINUTE, 2.0), ("A", 40 * DAY, 3.0), ("A", 80 * DAY, 4.0)]
    for _ in range(2):
        assert work().count() == 3 and rows_of(spark.table(name)) == want
        told = streams.batch_report(spark, f"{tmp_path}/r").collect()
        assert [(r.batch, r.symbol, r.attempted, r.inserted, r.ignored, r.rejected) for r in told] == [(1, "A", 4, 3, 1, 0)]


def test_rejects_are_kept_and_counted(spark, tmp_path):
    name = table(spark, tmp_path)
    raw = spark.createDataFrame([("A", "60000", "1", 0), ("A", "no", "1", 1), ("A", "120000", "x", 2), (None, "60000", "1", 3), ("B", None, None, 4)], "s string, open_time string, close string, pos int")
    raw = raw.withColumns({c: F.lit("1") for c in C.PRICES if c != "close"})
    batch = C.judged(raw, F.col("s"), ["pos"])
    for _ in range(2):
        streams.ingest_batch(batch, 4, name, f"{tmp_path}/f", ["pos"], report=f"{tmp_path}/r")
        told = {r.symbol: (r.batch, r.attempted, r.inserted, r.ignored, r.rejected) for r in streams.batch_report(spark, f"{tmp_path}/r").collect()}
        assert told == {"A": (4, 1, 1, 0, 2), "B": (4, 0, 0, 0, 1), None: (4, 0, 0, 0, 1)}
        assert {(r.pos, r.reject) for r in streams.rejects(spark, f"{tmp_path}/r").collect()} == {(1, "time"), (2, "close"), (3, "symbol"), (4, "time")}
    assert streams.ingest_batch(batch.limit(0), 5, name, f"{tmp_path}/f", ["pos"], report=f"{tmp_path}/r") is None
    assert once(batch.limit(0), f"{tmp_path}/x").count() == 0


def test_any_order_of_arrival_gives_one_scoring(spark, tmp_path):
    rng = random.Random(2)
    spec = (indicators.Indicator("roc", 5), indicators.Indicator("sma_ratio", 5), indicators.Indicator("rsi", 2))
    weights = {s.column: 0.3 for s in spec}
    every = [(s, m * step * MINUTE, 50 + rng.random(), i) for s, step in (("A", 30), ("B", 300)) for i, m in enumerate(range(400))]
    want = model.score(indicators.features(spark.createDataFrame(every, SCHEMA).drop("arrival"), spec), weights)
    want = {(r.symbol, r.open_time_ms): r.predicted_proba_spike for r in want.collect()}
    for order in range(2):
        rng.shuffle(every)
        parts = [every[:300], every[300:310], every[310:]] if order else [every[:700], every[700:]]
        names = [f"{n}{order}_{tmp_path.name}" for n in ("t", "p")]
        ingest.create_if_absent(spark, names[0])
        ingest.create_if_absent(spark, names[1], streams.SCORES)
        for number, part in enumerate(parts):
            new = streams.ingest_batch(spark.createDataFrame(part, SCHEMA), number, names[0], f"{tmp_path}/{order}", ["arrival"])
            fresh = once(streams.fresh_scores(spark.table(names[0]), new, spec, weights), f"{tmp_path}/{order}/scores-{number}")
            streams.put_scores(fresh, names[1])
            streams.put_scores(fresh, names[1])  # a replay
        got = [((r.symbol, r.open_time_ms), r.predicted_proba_spike) for r in spark.table(names[1]).collect()]
        assert len(got) == len(dict(got)) == len(want) and set(dict(got)) == set(want)
        assert all((v is None) == (want[k] is None) and (v is None or abs(v - want[k]) < 1e-9) for k, v in got)


def test_rows_in_order_replace_nothing(spark, tmp_path):
    spec, weights = (indicators.Indicator("roc", 3),), {"roc_3": 0.1}
    names = [f"{n}_{tmp_path.name}" for n in ("t", "p")]
    ingest.create_if_absent(spark, names[0])
    ingest.create_if_absent(spark, names[1], streams.SCORES)
    for number in range(3):
        part = spark.createDataFrame([("A", (number * 10 + i) * MINUTE, 5.0 + i, i) for i in range(10)], SCHEMA)
        new = streams.ingest_batch(part, number, names[0], f"{tmp_path}/f", ["arrival"])
        fresh = once(streams.fresh_scores(spark.table(names[0]), new, spec, weights), f"{tmp_path}/scores-{number}")
        assert fresh.count() == 10 and streams.put_scores(fresh, names[1]) == []
    late = spark.createDataFrame([("A", 12 * MINUTE + 1, 5.0, 1), ("A", -5 * MINUTE, 7.0, 1)], SCHEMA)
    new = streams.ingest_batch(late, 3, names[0], f"{tmp_path}/f", ["arrival"])
    fresh = streams.fresh_scores(spark.table(names[0]), new, spec, weights)
    assert new.count() == 1 and fresh.count() >= 4  # the late row and the three that look back on it


def test_a_fetch_of_many_symbols(spark, tmp_path):
    landing = table(spark, tmp_path, "landing")
    rows = spark.range(4 * 365).selectExpr("substring('ABCD', CAST(id % 4 AS INT) + 1, 1) AS symbol", f"(id DIV 4) * {DAY} AS open_time_ms", "double(id) AS close", "id AS arrival")
    tables.append(C.as_stored(rows), landing)
    marks = spark.createDataFrame([("A", 300 * DAY - MINUTE), ("B", 350 * DAY), ("C", 361 * DAY - MINUTE), ("none", None)], "symbol string, high_water_ms long")
    bounds = ingest.sync_bounds(marks, 360 * DAY).where("symbol <> 'none'")
    got = ingest.fetch(spark.table(landing), bounds)
    assert sorted((r.symbol, r.open_time_ms // DAY) for r in got.select("symbol", "open_time_ms").collect()) == [("A", d) for d in range(300, 360)] + [("B", d) for d in range(351, 360)]
    assert got.columns == spark.table(landing).columns
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "(open_month" in text.split("PartitionFilters: [isnotnull")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(open_time_ms" in text
    everything = ingest.fetch(spark.table(landing), ingest.sync_bounds(marks.where("symbol = 'none'").withColumn("symbol", F.lit("D")), 360 * DAY))
    assert everything.count() == 0  # history starts in 2017
    assert ingest.fetch(spark.table(landing), bounds.where("is_empty = 1")).count() == 0
