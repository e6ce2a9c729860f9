"""Registered candle queries on odd event tables."""

import math
import random

from pyspark.sql import functions as F

from tickforge.operators import model
from tickforge.plans import registry

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def events_table(spark, folder, rows):
    """rows: a frame with event_id, minute, user_id, event_type and value."""
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(minute AS INT), 0)")
    rows.withColumn("ts", ts).withColumn("props", F.lit("{}")).select(*EVENT_COLUMNS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_lines_of_a_large_user_are_bounded(spark, tmp_path):
    n = 2 * registry.LINE_IDS + 500
    rows = spark.range(n).selectExpr("id AS event_id", "id % 1440 AS minute", "IF(id % 3 = 0, id, 7) AS user_id", "'a' AS event_type", "CAST(id AS DOUBLE) AS value")
    folder = events_table(spark, tmp_path, rows)
    held = registry.raw_lines(registry.events(spark, folder)).select("user_id", F.size(F.from_json("value", "array<array<string>>")).alias("n"))
    top, total = held.agg(F.max("n"), F.sum("n")).first()
    assert total == n and top <= registry.LINE_IDS
    got = registry.q04_normalise_candles(spark, folder)
    assert got.count() == n and got.where("user_id = 7").count() == rows.where("user_id = 7").count()
    assert got.agg(F.sum("close")).first()[0] == n * (n - 1) / 2


def test_rows_left_out_of_the_fit_are_reported(spark, tmp_path):
    rng = random.Random(6)
    closes, v = [], 50.0
    for _ in range(1500):
        v *= math.exp(rng.gauss(0, 0.03))
        closes.append(v)
    closes[300] = 0.0
    rows = spark.createDataFrame([(i, i, 1, "a", v) for i, v in enumerate(closes)], "event_id long, minute int, user_id long, event_type string, value double")
    folder = events_table(spark, tmp_path, rows)
    got = registry.q20_logit_table(spark, folder).collect()
    assert len(got) == len(model.FEATURES) and {r.n_not_finite for r in got} == {2}
    assert {r.n_rows for r in got} == {registry.q19_training_sample(spark, folder).count() - 2}


def test_events_without_a_value_are_no_offers(spark, tmp_path):
    rows = spark.range(300).selectExpr("id AS event_id", "id DIV 2 AS minute", "id % 5 AS user_id", "'a' AS event_type", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 9 = 0 THEN double('NaN') ELSE 1.0D + id % 7 END AS value")
    folder = events_table(spark, tmp_path, rows)
    got = registry.q18_feature_matrix(spark, folder).collect()
    assert {r.open_time_ms for r in got} == {r.open_time_ms for r in registry.candles(spark, folder).collect()} and len(got) > 100
    assert all(r.close is not None for r in got) and any(r.macd_diff is not None for r in got)
