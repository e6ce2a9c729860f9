"""Indicators carried as state over rows out of order, against the published formulas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import by_formula
from tickforge.operators.indicators import DEFAULT_SPEC, Indicator
from tickforge.streaming import features

SCHEMA = "symbol string, open_time_ms long, close double, arrival long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MINUTE = 60_000


@pytest.fixture()
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def run(spark, folder, parts, delay, spec=DEFAULT_SPEC):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in-{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")
    out = features.stream_features(stream, delay, spec)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").toPandas()


@pytest.mark.parametrize("cuts", [(7, 1, 200, 92), (300,), (1,) * 300])
def test_any_cut_of_a_series(cuts):
    rng = random.Random(3)
    close = [50 + rng.random() for _ in range(300)]
    series, made = features.Series(DEFAULT_SPEC), []
    for at, n in zip(np.cumsum((0, *cuts)), cuts, strict=False):
        before = series
        made.append(pd.DataFrame(series.add(np.array(close[at : at + n]))))
        series = features.Series(DEFAULT_SPEC, before.n, before.means, before.closes)
    got, want = pd.concat(made, ignore_index=True), by_formula(pd.Series(close))
    for s in DEFAULT_SPEC:
        assert (got[s.column].isna() == want[s.column].isna()).all() and (got[s.column] - want[s.column]).abs().max() < 1e-8


def test_rows_out_of_order_and_late(spark, tmp_path, rocks):
    rng = random.Random(5)
    series = {s: [50 + rng.random() for _ in range(400)] for s in "AB"}
    every = [(s, i * 10 * MINUTE, v, i) for s, own in series.items() for i, v in enumerate(own)]
    every += [(s, ms, -1.0, 10_000 + i) for s, ms, _, i in every if i % 50 == 0]  # later offers of minutes that wait
    parts = [[], [], []]
    for r in every:
        part = min(2, r[1] // (1400 * MINUTE))
        parts[min(2, part + (r[1] % (1400 * MINUTE) > 1200 * MINUTE and rng.random() < 0.4))].append(r)
    late = [("A", 3 * MINUTE, 7.0, 1), ("B", 20 * MINUTE + 5, 8.0, 2)]
    parts[2] += late
    clock = [(s, 10_000 * MINUTE, None, 0) for s in "AB"]
    for p in parts:
        rng.shuffle(p)
    got = run(spark, tmp_path, [*parts, clock], "5 hours")
    assert sorted(zip(got[got.late].symbol, got[got.late].open_time_ms, got[got.late].close)) == [r[:3] for r in late]
    for s, own in series.items():
        mine = got[(got.symbol == s) & ~got.late].sort_values("open_time_ms").reset_index(drop=True)
        assert mine.open_time_ms.tolist() == [i * 10 * MINUTE for i in range(400)] and mine.close.tolist() == own
        want = by_formula(pd.Series(own))
        for c in (x.column for x in DEFAULT_SPEC):
            assert (mine[c].isna() == want[c].isna()).all() and (mine[c] - want[c]).abs().max() < 1e-8


def test_zero_closes_and_waiting_rows(spark, tmp_path, rocks):
    rows = [("A", i * MINUTE, v, i) for i, v in enumerate([0.0, 0.0, 5.0, 0.0, 2.0])]
    spec = (Indicator("roc", 1), Indicator("sma_ratio", 2))
    got = run(spark, tmp_path, [rows, [("A", 4 * MINUTE, None, 0)]], "0 seconds", spec).sort_values("open_time_ms")
    assert got.open_time_ms.tolist() == [i * MINUTE for i in range(4)]  # the newest waits
    told = [None if x != x else x for x in got.roc_1]
    assert told == [None, None, float("inf"), -100.0] and [None if x != x else x for x in got.sma_ratio_2] == [None, None, 2.0, 0.0]
    assert not spark.read.parquet(f"{tmp_path}/out").where(F.col("late")).count()


def test_means_of_frames_are_those_of_the_sql():
    """To the last bit, whatever the cuts."""
    import duckdb

    rng = random.Random(4)
    close = [round(rng.uniform(0, 100), 2) for _ in range(1000)]
    spec, made = tuple(Indicator("sma_ratio", k) for k in (14, 20, 140)), []
    series = features.Series(spec)
    for a, b in ((0, 5), (5, 338), (338, 1000)):
        made.append(series.add(np.array(close[a:b])))
    for s in spec:
        own = np.concatenate([m[s.column] for m in made])[s.window - 1 :].tolist()
        sql = f"SELECT v / avg(v) OVER (ORDER BY i ROWS BETWEEN {s.window - 1} PRECEDING AND CURRENT ROW) FROM (SELECT unnest($1::DOUBLE[]) AS v, unnest(range(1000)) AS i) ORDER BY i"
        assert own == [r[0] for r in duckdb.execute(sql, [close]).fetchall()][s.window - 1 :], s.window
