"""Labels, indicators and the model: golden numbers, hand-computed series, properties."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import SERIES, by_formula, one_series, series, values
from tickforge.operators import blocks, labels, model
from tickforge.operators import indicators as I

GOLDEN = {
    "rsi_backward_14": (13, 447301.279854), "roc_14": (14, 5644817.870771), "roc_140": (140, 5973921.026001), "macd_diff": (33, -8.638865),
    "sma_ratio_14": (13, 8928.413758), "sma_ratio_140": (139, 8822.891926), "bb_width_14": (13, 3236668.897015), "bb_width_140": (139, 3451950.419207),
}
FIT = {
    "rsi_backward_14": (0.22649047481, 0.03359423239), "roc_14": (-0.00002829786155, 0.00023611654982), "roc_140": (0.00014642144562, 0.00037051522969),
    "macd_diff": (0.02928614819, 0.03637720124), "sma_ratio_14": (-3.52282386853, 3.33396895922), "sma_ratio_140": (-82.65881018325, 5.99528976205),
    "bb_width_14": (-0.00342460638, 0.00127955118), "bb_width_140": (0.00023651543, 0.00360382387),
}


def test_small_series(spark):
    df = series(spark, SERIES)
    want = [11, 11, 12, 12, 12, 12, 8]
    assert values(labels.forward_max(df, 3), "rolling_max") == want
    assert values(labels.forward_max_two_scans(df, 3), "rolling_max") == want
    rated = labels.ratio(labels.forward_max(df, 3))
    assert values(rated, "ratio") == pytest.approx([1.1, 1, 12 / 11, 4 / 3, 1, 1, 1])
    flagged = labels.spike_flag(rated)
    assert flagged.first().p90 == pytest.approx(1.1933333333) and values(flagged, "spike_flag") == [0, 0, 0, 1, 0, 0, 0]
    assert values(I.exponential_mean(df, 0.5), "ema") == pytest.approx([10, 10.5, 10.75, 9.875, 10.9375, 11.46875, 9.734375])
    roc = values(I.features(df, (I.Indicator("roc", 2),)), "roc_2")
    assert roc[:2] == [None, None] and roc[2:] == pytest.approx([10, -18.181818, 9.090909, 33.333333, -33.333333])


def test_flat_zero_and_missing(spark):
    flat = I.features(series(spark, [5.0] * 20), (I.Indicator("rsi", 14), I.Indicator("bb_width", 14)))
    assert values(flat, "rsi_14") == [None] * 13 + [100.0] * 7 and values(flat, "bb_width_14")[13:] == [0.0] * 7
    zero = values(I.features(series(spark, [0.0, 0.0, 5.0, -1.0]), (I.Indicator("roc", 1),)), "roc_1")
    assert zero == [None, None, math.inf, -120.0]
    rated = labels.ratio(labels.forward_max(series(spark, [0.0, 0.0, 1.0]), 2))
    assert values(rated, "ratio") == [None, math.inf, 1.0]
    assert values(labels.spike_flag(rated), "spike_flag")[0] == 0


def test_quantile_is_that_of_pandas(spark, monkeypatch):
    rng = random.Random(1)
    rows, want = [], {}
    for s in range(30):
        own = [rng.choice([rng.random(), 1.7, 0.3]) for _ in range(rng.randint(1, 120))]
        rows += [(str(s), v) for v in own] + [(str(s), None)]
        want[str(s)] = pd.Series(own).quantile(0.9)
    rows += [("ties", v) for v in [1.1] * 50 + [0.3] * 30 + [1.7] * 21]
    want["ties"] = 1.7
    df = spark.createDataFrame(rows, "symbol string, v double")
    for whole in (10_000, 100):
        monkeypatch.setattr(labels, "WHOLE", whole)
        if whole == 100:
            big = [rng.gauss(0, 1) for _ in range(30_000)]
            want["big"] = pd.Series(big).quantile(0.9)
            df = df.where("symbol = 'ties'").unionByName(spark.createDataFrame([("big", v) for v in big], df.schema))
        got = {r.symbol: r.q for r in labels.exact_quantile(df, "v", 0.9, "q").collect()}
        assert got == pytest.approx({k: want[k] for k in got}, rel=1e-15)


def test_blocks_join_up(spark, monkeypatch):
    """Short blocks give what one long frame gives, on several symbols in any order."""
    rng = np.random.default_rng(5)
    frames = {s: pd.Series(np.exp(np.cumsum(rng.normal(0, 0.02, 700))) + 1) for s in ("A", "B")}
    rows = [(s, i * 60_000, float(v)) for s, f in frames.items() for i, v in enumerate(f)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, open_time_ms long, close double")
    made = I.features(df).orderBy("symbol", "open_time_ms").toPandas()
    for s, f in frames.items():
        own, want = made[made["symbol"] == s].reset_index(drop=True), by_formula(f)
        for c in GOLDEN:
            assert np.array_equal(own[c].isna(), want[c].isna()), c
            assert np.allclose(own[c].dropna(), want[c].dropna(), rtol=1e-9, atol=1e-9), c
    short = I.exponential_mean(df, 0.9)  # blocks of 130 rows
    for s, f in frames.items():
        got = values(short.where(F.col("symbol") == s), "ema")
        assert np.allclose(got, f.ewm(alpha=0.9, adjust=False).mean(), rtol=1e-12)
    a = labels.forward_max(df, 50)
    b = labels.forward_max_two_scans(df, 50)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert blocks.block_for([1 / 14]) == 4048


def test_means_of_frames_are_those_of_the_sql(spark):
    """To the last bit: a quotient may be an exact half of its last place, and there the order of a sum decides."""
    import duckdb

    rng = random.Random(4)
    rows = [("A", i * 60_000, round(rng.uniform(0, 100), 2)) for i in range(6000)]
    spec = *(I.Indicator("sma_ratio", k) for k in (14, 20, 140)), I.Indicator("bb_width", 140)
    got = I.features(spark.createDataFrame(rows, "symbol string, open_time_ms long, close double"), spec)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1::BIGINT[]) AS ms, unnest($2::DOUBLE[]) AS close", [[r[1] for r in rows], [r[2] for r in rows]])
    for k in (14, 20, 140):
        want = con.execute(f"SELECT close / avg(close) OVER (ORDER BY ms ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) FROM t ORDER BY ms").fetchall()
        own = values(got, f"sma_ratio_{k}")
        assert own[: k - 1] == [None] * (k - 1) and own[k - 1 :] == [r[0] for r in want[k - 1 :]], k
    width = by_formula(pd.Series([r[2] for r in rows]))["bb_width_140"]
    assert np.allclose(values(got, "bb_width_140")[139:], width[139:], rtol=1e-9)


def test_one_exchange_for_the_frames(spark):
    plan = I.features(series(spark, SERIES), tuple(s for s in I.DEFAULT_SPEC if s.kind in I.FRAMES))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Python" not in text


def test_golden_numbers_and_fit(spark):
    rows = one_series(spark)
    flagged = labels.spike_flag(labels.ratio(labels.forward_max(rows)))
    matrix = I.features(flagged).cache()
    r = matrix.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in GOLDEN], *[F.sum(c).alias(c) for c in GOLDEN], F.sum("rolling_max").alias("top"), F.sum("ratio").alias("ratio"), F.max("p90").alias("p90"), F.sum("spike_flag").alias("flags")).first()
    for c, (gaps, total) in GOLDEN.items():
        assert r[f"n_{c}"] == gaps and r[c] == pytest.approx(total, rel=1e-9, abs=1e-6)
    assert (r.top, r.ratio, r.p90) == pytest.approx((2643092.08, 397587.266044, 56.82302405498281), rel=1e-12) and r.flags == 897
    assert model.complete_rows(matrix).count() == 8821
    sample = model.training_sample(matrix).cache()
    ends = sample.agg(F.count(F.lit(1)), F.sum("spike_flag"), F.min("open_time"), F.max("open_time")).first()
    assert tuple(ends) == (8767, 879, "2024-01-01 13:12", "2024-01-30 21:49")
    fit = model.fit_logit(sample)
    for t in model.coefficient_table(fit, sample).collect():
        assert (t.coef, t.std_err) == pytest.approx(FIT[t.term], rel=1e-6)
        assert t.ci_low < t.coef < t.ci_high
    scored = model.score(sample, model.coefficients_of(fit)).withColumn("band", model.signal_band())
    counts = {x.band: x["count"] for x in scored.groupBy("band").count().collect()}
    assert (counts["short"], counts["long"]) == (7472, 1088)


def test_missing_closes_and_clashing_names(spark):
    df = series(spark, [1.0, 2.0, None, 3.0, 4.0])
    assert values(I.features(df, (I.Indicator("sma_ratio", 2),)), "sma_ratio_2")[1:4] == [4 / 3, None, None]
    assert values(labels.forward_max(df, 2), "rolling_max") == [2, 2, 3, 4, 4]
    for spec in (I.Indicator("rsi", 14), I.Indicator("macd_diff")):
        with pytest.raises(Exception, match="a close is missing"):
            I.features(df, (spec,)).collect()
    named = df.na.drop().withColumns({c: F.lit("own") for c in ("rolling_max", "ROC_1", "p90", "spike_flag", "ema", "b")})
    assert labels.forward_max(named, 2).columns.count("rolling_max") == 1
    made = I.features(labels.spike_flag(labels.ratio(labels.forward_max(named, 2))), (I.Indicator("roc", 1),))
    assert made.columns[-1] == "roc_1" and "ROC_1" not in made.columns and {r.b for r in made.collect()} == {"own"}
    assert values(I.exponential_mean(named, 0.5), "ema") == [1, 1.5, 2.25, 3.125]
    with pytest.raises(ValueError, match="underscores"):
        I.features(df.withColumn("__i", F.lit(1)), (I.Indicator("roc", 1),))


def test_a_saved_fit(spark, tmp_path):
    rng = random.Random(4)
    rows = [(x, int(rng.random() < 1 / (1 + math.exp(-2 * x)))) for x in (rng.gauss(0, 1) for _ in range(300))]
    fit = model.fit_logit(spark.createDataFrame(rows, "x double, y int"), ["x"], "y")
    model.save(fit, str(tmp_path / "m"))
    assert model.coefficients_of(model.saved(str(tmp_path / "m")), ["x"]) == model.coefficients_of(fit, ["x"])


def test_large_tables_join_by_salted_shuffle(spark, monkeypatch):
    from tickforge.operators import joins

    rng = random.Random(9)
    rows = [(s, i * 60_000, rng.random()) for s in "ABC" for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, open_time_ms long, close double")
    run = lambda: sorted(map(tuple, labels.spike_flag(labels.ratio(labels.forward_max(df, 5))).collect()))
    want = run()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    assert run() == want


def test_brackets_narrow_until_few_rows_are_left(spark, monkeypatch):
    rng = random.Random(3)
    own = [rng.gauss(0, 1) for _ in range(4000)] + [math.inf] * 30 + [0.5] * 900
    df = spark.createDataFrame([("big", v) for v in own] + [("ties", 1.0)] * 500, "symbol string, v double")
    monkeypatch.setattr(labels, "WHOLE", 100)
    monkeypatch.setattr(labels, "NEAR_ROWS", 60)
    for q in (0.0, 0.3, 0.69, 0.9):
        got = {r.symbol: r.q for r in labels.exact_quantile(df, "v", q, "q").collect()}
        assert got == {"big": pytest.approx(np.quantile(np.array(own), q), rel=1e-12), "ties": 1.0}
    inner = labels._brackets(df, 0.3).where("symbol = 'big'").first()
    assert sum(inner.lo <= v <= inner.hi for v in own) <= 60


def test_separable_labels_are_refused(spark):
    df = spark.createDataFrame([(float(x), int(x > 0)) for x in range(-20, 20) if x], "x double, y int")
    with pytest.raises(model.SeparationError):
        model.fit_logit(df, ["x"], "y")
    with pytest.raises(ValueError, match="finite"):
        model.fit_logit(spark.createDataFrame([(math.inf, 1), (1.0, 0)], "x double, y int"), ["x"], "y")


def test_blocks_are_spread_over_tasks(spark):
    df = series(spark, [float(i % 7) for i in range(40)])
    rows = blocks.in_blocks(blocks.number_rows(df), back=1, block=4)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocks.spread(rows, 3).rdd.getNumPartitions() == min(3, most)
    assert blocks.spread(rows, 10**9).rdd.getNumPartitions() == most
    assert blocks.spread(rows, 0) is rows
    scanned = blocks.spread(rows, 3).withColumn("top", F.max("close").over(blocks.by_block()))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    after = plan[: plan.index("REPARTITION_BY_NUM")]
    assert after.count("Exchange") == 1  # the window has its partitions already
