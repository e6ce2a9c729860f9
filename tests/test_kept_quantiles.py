"""Ratios and sketches that appends keep up, and quantiles that they bracket."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import ingest, kept_quantiles, labels, tables
from tickforge.streaming import candles as streams
from tickforge.streaming import ratios

SCHEMA = "symbol string, open_time_ms long, close double, arrival long"
MINUTE, DAY, AHEAD = 60_000, 86_400_000, 24


def levels(df):
    return {r.symbol: r.p for r in df.collect()}


def sketched(df):
    return df.where("ratio IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("ratio", F.lit(kept_quantiles.ITEMS)).alias("sketch"))


def test_appends_replays_and_late_rows(spark, tmp_path):
    names = [f"{n}_{tmp_path.name}" for n in ("t", "r", "s")]
    for name, schema in zip(names, (ingest.STORED, ratios.RATIOS, kept_quantiles.SKETCHES)):
        ingest.create_if_absent(spark, name, schema)
    rng = random.Random(2)
    rows = [(s, d * DAY + h * 3_600_000, rng.choice([0.0, 1.0, 2.5]) + rng.random(), 0) for s in ("A", "B") for d in range(95) for h in range(0, 24, 2)]
    late = [r for r in rows if r[0] == "A" and 85 * DAY < r[1] < 88 * DAY]
    batches = [[r for r in rows if r[1] < 60 * DAY], [r for r in rows if 60 * DAY <= r[1] < 93 * DAY and r not in late], [r for r in rows if r[1] >= 93 * DAY] + late]
    for number, part in enumerate(batches):
        new = streams.ingest_batch(spark.createDataFrame(part, SCHEMA), number, names[0], f"{tmp_path}/f", ["arrival"])
        fresh = ratios.once(ratios.fresh_ratios(spark.table(names[0]), new, AHEAD), f"{tmp_path}/fresh-{number}")
        if number:  # nothing is read or made again long before the batch
            assert fresh.agg(F.min("open_time_ms")).first()[0] >= (60, 85)[number - 1] * DAY - AHEAD * 2 * 3_600_000
        for _ in range(2):
            ratios.put_ratios(fresh, names[1], names[2])
    want = labels.ratio(labels.forward_max(spark.createDataFrame(rows, SCHEMA).drop("arrival"), AHEAD))
    as_set = lambda df: {(r.symbol, r.open_time_ms, r.rolling_max, r.ratio) for r in df.collect()}
    assert as_set(spark.table(names[1])) == as_set(want) and spark.table(names[1]).count() == len(rows)
    assert spark.table(names[2]).agg(F.sum("n")).first()[0] == want.where("ratio IS NOT NULL").count()
    got = levels(kept_quantiles.kept_quantile(spark.table(names[1]), spark.table(names[2]), "ratio", 0.9, "p"))
    assert got == levels(labels.exact_quantile(want, "ratio", 0.9, "p")) and set(got) == {"A", "B"}
    assert kept_quantiles.sketch_partitions(spark, names[1], "ratio", names[2], []) == []
    assert tables.partitions(spark.table(names[2])) != []


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_sketches_only_guess(spark, q):
    """True sketches, those of other rows, and none: the same quantiles, ties and infinite values included."""
    rng = random.Random(3)
    rows = [("A", rng.choice([1.0, 1.5, rng.random()])) for _ in range(4000)] + [("B", rng.gauss(0, 1)) for _ in range(3000)] + [("C", 2.0), ("D", None)]
    rows += [("E", float("inf")), ("E", 1.0), ("E", 2.0), ("F", float("inf")), ("F", float("inf"))]
    df = spark.createDataFrame(rows, "symbol string, ratio double").repartition(3)
    want = levels(labels.exact_quantile(df, "ratio", q, "p"))
    true = sketched(df)
    moved = sketched(df.withColumn("ratio", F.col("ratio") + 100))
    for sketches in (true, moved, true.where("symbol = 'A'"), true.limit(0)):
        assert levels(kept_quantiles.kept_quantile(df, sketches, "ratio", q, "p")) == want
    assert set(want) == {"A", "B", "C", "E", "F"} and want["F"] == float("inf")
    assert levels(kept_quantiles.kept_quantile(df.limit(0), true, "ratio", q, "p")) == {}


def test_wide_brackets_are_narrowed(spark, monkeypatch):
    df = spark.range(5000).select(F.lit("A").alias("symbol"), F.col("id").cast("double").alias("ratio"))
    for most in (10, 100):
        monkeypatch.setattr(kept_quantiles, "NEAR_ROWS", most)
        assert levels(kept_quantiles.kept_quantile(df, sketched(df), "ratio", 0.9, "p")) == {"A": pytest.approx(4499.1)}
