"""Means over missing closes against pandas' own."""

import random

import numpy as np
import pandas as pd
import pytest

from tests.fixtures import series, values
from tickforge.operators import gaps, indicators


def holes(n, seed, share=0.3, runs=0):
    rng = random.Random(seed)
    out = [None if rng.random() < share else 50 + rng.random() * 10 for _ in range(n)]
    for _ in range(runs):
        a = rng.randrange(n)
        for i in range(a, min(n, a + 400)):
            out[i] = None
    return out


CASES = [holes(900, 1), holes(6000, 2, 0.9), holes(5000, 3, 0.1, 6), [None] * 30 + holes(200, 4), [1.0] + [None] * 5000 + [2.0, 3.0, None], [None] * 50, [5.0] * 60]


def close_to(got, want):
    want = [None if x != x else x for x in want]
    assert [x is None for x in got] == [x is None for x in want]
    assert all(a is None or abs(a - b) < 1e-8 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("case", range(len(CASES)))
def test_means(spark, case):
    close = CASES[case]
    df = spark.createDataFrame([("A", i * 60_000, v) for i, v in enumerate(close)], "symbol string, open_time_ms long, close double")
    s = pd.Series(close, dtype=float)
    for alpha, periods in ((0.2, 1), (2 / 27, 26)):
        close_to(values(gaps.gap_mean(df, alpha, periods), "ema"), s.ewm(alpha=alpha, adjust=False, min_periods=periods).mean())
    move = s.diff()
    up, down = (x.where(x > 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (move, -move))
    rsi = (100 - 100 / (1 + up / down)).where(down != 0, 100.0).where(down.notna())
    close_to(values(gaps.gap_rsi(df), "rsi"), rsi)
    macd = s.ewm(span=12, adjust=False, min_periods=12).mean() - s.ewm(span=26, adjust=False, min_periods=26).mean()
    close_to(values(gaps.gap_macd_diff(df), "macd_diff"), macd - macd.ewm(span=9, adjust=False, min_periods=9).mean())


def test_many_blocks_and_symbols(spark, monkeypatch):
    monkeypatch.setattr(gaps, "BLOCK", 16)
    parts = {s: holes(400, i, i / 5, i) for i, s in enumerate("ABCDE")}
    rows = [(s, i * 60_000, v, "own") for s, own in parts.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "symbol string, open_time_ms long, close double, ema string").repartition(5)
    got = gaps.gap_mean(df, 0.3)
    for s, own in parts.items():
        close_to(values(got.where(f"symbol = '{s}'"), "ema"), pd.Series(own, dtype=float).ewm(alpha=0.3, adjust=False).mean())


def test_without_gaps_they_are_the_plain_ones(spark):
    df = series(spark, np.random.default_rng(1).uniform(1, 2, 3000).tolist())
    whole = indicators.features(df, (indicators.Indicator("rsi", 14), indicators.Indicator("macd_diff")))
    close_to(values(gaps.gap_rsi(df, name="g"), "g"), [float("nan") if v is None else v for v in values(whole, "rsi_14")])
    close_to(values(gaps.gap_macd_diff(df, name="g"), "g"), [float("nan") if v is None else v for v in values(whole, "macd_diff")])
    assert gaps.gap_mean(df.limit(0), 0.2).count() == 0
