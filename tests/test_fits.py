"""Fits by symbol against one Newton solver for each."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import fits

X = ["u", "v"]


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.fixture(scope="module")
def parts():
    rng = np.random.default_rng(2)
    out = {}
    for i, (b, scale) in enumerate([((1.0, -0.5), 1), ((0.01, 3.0), 100), ((-2.0, 0.0), 0.1), ((0.3, 0.3), 1)]):
        x = rng.normal(size=(300 + 50 * i, 2)) * [scale, 1]
        out[f"s{i}"] = x, (rng.random(len(x)) < 1 / (1 + np.exp(-x @ np.array(b)))).astype(int)
    return out


def frame(spark, parts, more=()):
    rows = [(s, float(a), float(b), int(y)) for s, (x, ys) in parts.items() for (a, b), y in zip(x, ys, strict=True)]
    return spark.createDataFrame(rows + list(more), "symbol string, u double, v double, spike_flag int").repartition(4)


def test_each_symbol_has_its_own_fit(spark, parts):
    odd = [("apart", float(i), 1.0, int(i > 3)) for i in range(-9, 9)] + [("one", 1.0, 2.0, 1)] * 5 + [("flat", 1.0 + i, 2.0 + 2 * i, i % 2) for i in range(10)]
    odd += [("s0", math.inf, 1.0, 1), ("s0", math.nan, 1.0, 0), ("s0", None, 1.0, 0), ("s1", 1.0, 1.0, None), (None, 1.0, 1.0, 1), ("none", None, 1.0, 1)]
    got = {r.symbol: r for r in fits.fit_by_symbol(frame(spark, parts, odd), X).collect()}
    assert set(got) == {*parts, "apart", "one", "flat"}
    for s, (x, y) in parts.items():
        b, se = newton(x, y)
        assert got[s].status == "converged" and got[s].n_rows == len(x) and 1 < got[s].steps < 20
        assert got[s].b == pytest.approx(b, rel=1e-7, abs=1e-10) and got[s].se == pytest.approx(se, rel=1e-6)
    assert (got["apart"].status, got["flat"].status) == ("separable", "singular") and got["one"].status in ("separable", "singular")
    assert all(got[s].b is None for s in ("apart", "one", "flat"))


def test_table_of_terms(spark, parts):
    few = {"s0": parts["s0"]}
    rows = fits.fit_table(fits.fit_by_symbol(frame(spark, few, [("one", 1.0, 2.0, 1)] * 5), X), X).collect()
    b, se = newton(*parts["s0"])
    told = {(r.symbol, r.term): r for r in rows}
    assert set(told) == {("s0", "u"), ("s0", "v"), ("one", None)}
    for i, c in enumerate(X):
        r = told["s0", c]
        assert (r.coef, r.std_err, r.z) == pytest.approx((b[i], se[i], b[i] / se[i]), rel=1e-6)
        assert r.p_value == pytest.approx(math.erfc(abs(b[i] / se[i]) / math.sqrt(2)), rel=1e-5) and r.ci_low < r.coef < r.ci_high


def test_no_rows_and_too_few_steps(spark, parts):
    df = frame(spark, parts)
    assert fits.fit_by_symbol(df.limit(0), X).count() == 0
    assert {r.status for r in fits.fit_by_symbol(df, X, steps=2).collect()} <= {"open", "converged"}
    assert fits.fit_by_symbol(df.where(F.col("symbol") == "s1"), X).first().status == "converged"
