"""Scalars, sources and ingest: hand-computed answers and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SERIES, SF, one_series, series, values
from tickforge.functions import scalars as S
from tickforge.operators import ingest, latest
from tickforge.sources import candles as C

SCHEMA = "symbol string, open_time_ms long, open_time string, close double, arrival long"


def offers(spark, rows):
    return spark.createDataFrame(rows, "symbol string, open_time_ms long, close double, arrival long").withColumn(
        "open_time", S.local_minute_text(F.col("open_time_ms"))
    )


def test_lenient_numbers(spark):
    cases = {"1.5": 1.5, " 1.5 ": 1.5, "1e3": 1000.0, "": None, "abc": None, "1.0d": None, "1f": None, "NaN": None, "inf": float("inf"), None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.lenient_double(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(S.ieee_ratio(F.col("a"), F.col("b"))).collect()] == [float("inf"), float("-inf"), None, 0.25, None]


def test_times_do_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Europe/Budapest"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:45.5' AS ts").select(S.ntz_minute_ms(F.col("ts")).alias("ms"))
            r = r.select("ms", S.local_minute_text(F.col("ms")).alias("t"), S.local_text_to_ntz(S.local_minute_text(F.col("ms"))).cast("string").alias("n")).first()
            assert (r.ms, r.t, r.n) == (1710037800000, "2024-03-10 04:30", "2024-03-10 04:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bounds(spark):
    marks = spark.createDataFrame([("empty", None), ("behind", 120000), ("even", 180000)], "symbol string, high_water_ms long")
    got = {r.symbol: (r.start_ms, r.end_ms, r.is_empty) for r in ingest.sync_bounds(marks, 245000).collect()}
    assert got == {"empty": (1483228800000, 240000, 1), "behind": (180000, 240000, 0), "even": (240000, 240000, 1)}
    rows = series(spark, SERIES)
    assert values(C.between(rows, 60_000, 180_000), "close") == [11.0, 11.0]


def test_insert_or_ignore(spark):
    stored = offers(spark, [("A", 60_000, 1.0, 0)])
    batch = offers(spark, [("A", 60_000, 9.0, 1), ("A", 120_000, 3.0, 2), ("A", 120_001, 4.0, 3), ("A", 180_000, 5.0, 4), (None, 1, 1.0, 5), ("A", None, 1.0, 6)])
    new = ingest.insert_or_ignore(stored, batch, ["arrival"])
    assert sorted((r.open_time_ms, r.close) for r in new.collect()) == [(120_000, 3.0), (180_000, 5.0)]
    report = ingest.sync_report(batch.where("arrival < 5"), new).first()
    assert (report.attempted, report.inserted, report.ignored) == (4, 2, 2)
    assert ingest.insert_or_ignore(stored, batch.limit(0), ["arrival"]).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_any_split_gives_one_result(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("AB"), rng.randrange(40) * 60_000 + rng.randrange(3), float(i), i) for i in range(150)]
    whole = ingest.first_of_minute(offers(spark, rows), ["arrival"]).drop("__minute")
    have = offers(spark, rows).limit(0)
    for p in range(parts):
        step = ingest.insert_or_ignore(have, offers(spark, rows[p * 150 // parts : (p + 1) * 150 // parts]), ["arrival"])
        have = spark.createDataFrame(have.collect() + step.select(*have.columns).collect(), have.schema)
    assert sorted(map(str, have.collect())) == sorted(map(str, whole.select(*have.columns).collect()))


def test_raw_feed(spark):
    line = '[[60000,"1.5","2","1","1.7","10",0,0,0,0,0,0],[119999,"x","2","1","1.8","",0,0,0,0,0,0],["no","1","1","1","1","1",0,0,0,0,0,0]]'
    raw = C.explode_raw(spark.createDataFrame([(line, 1)], "value string, batch int"))
    good, bad = C.normalise(raw, "S", ["batch", "pos"])
    assert [(r.open_time_ms, r.open_time, r.open, r.close, r.volume) for r in good.orderBy("pos").collect()] == [
        (60000, "1970-01-01 02:01", 1.5, 1.7, 10.0), (119999, "1970-01-01 02:01", None, 1.8, None),
    ]
    assert bad.count() == 1


def test_table(spark, tmp_path):
    name = f"t_{tmp_path.name}"
    ingest.create_if_absent(spark, name)
    rows = offers(spark, [("S", 60_000, 1.0, 1), ("S", 60_001, 2.0, 2), ("S/=%", 86_400_000 * 9, 3.0, 3)])
    assert ingest.append_new(name, rows, ["arrival"]).count() == 2
    assert ingest.append_new(name, rows, ["arrival"]).count() == 0
    ingest.create_if_absent(spark, name)
    assert {(r.symbol, str(r.open_date), r.close, r.low) for r in spark.table(name).collect()} == {("S", "1970-01-01", 1.0, None), ("S/=%", "1970-01-10", 3.0, None)}
    ingest.reset(spark, name)
    assert spark.table(name).count() == 0 and spark.table(name).schema == ingest.STORED
    assert ingest.append_new(name, rows.limit(0), ["arrival"]).count() == 0
    assert ingest.append_new(name, rows, ["arrival"]).count() == 2


def test_a_batch_reads_only_its_months(spark, tmp_path):
    name = f"t_{tmp_path.name}"
    ingest.create_if_absent(spark, name)
    days = [("S", d * 30 * 86_400_000 + m * 60_000, 1.0, d) for d in range(12) for m in range(3)]
    ingest.append_new(name, offers(spark, days), ["arrival"])
    batch = C.as_stored(offers(spark, [("S", 330 * 86_400_000, 5.0, 1), ("S", 330 * 86_400_000 + 600_000, 6.0, 2)]), "arrival")
    old = ingest.touched(spark.table(name), batch)
    new = ingest.insert_or_ignore(old, batch, ["arrival"])
    text = new._jdf.queryExecution().executedPlan().toString()
    assert "open_month" in text[text.index("PartitionFilters: ["):].split("]")[0] and "GreaterThanOrEqual(open_time_ms" in text
    assert [r.close for r in new.collect()] == [6.0]
    assert len(old.inputFiles()) == 1  # of twelve


def test_the_range_goes_down_to_the_scan(spark):
    raw = spark.read.schema(C.EVENTS).parquet(f"{SF}/events.parquet")
    ends = "2024-01-05 00:00", "2024-01-06 00:00"
    rows = offers_of(C.events_between_text(raw, *ends))
    text = ingest.first_of_minute(rows, ["arrival"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
    kept = {r.arrival for r in rows.select("arrival").collect()}
    assert kept == {r.arrival for r in offers_of(raw).where(F.col("open_time").between(*ends)).select("arrival").collect()}


def offers_of(found):
    return C.from_events(found).withColumn("open_time", S.local_minute_text(F.col("open_time_ms")))


def test_latest(spark):
    df = series(spark, SERIES).withColumn("open_time", S.local_minute_text(F.col("open_time_ms")))
    assert [r.close for r in latest.newest(df, 3).collect()] == [8.0, 12.0, 12.0]
    assert [r.close for r in latest.tail(df, 2).collect()] == [12.0, 8.0]
    assert "TakeOrderedAndProject" in latest.newest(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_golden_rows(spark):
    rows = one_series(spark)
    r = rows.agg(F.count(F.lit(1)), F.round(F.sum("close"), 2), F.min("open_time"), F.max("open_time")).first()
    assert tuple(r) == (8961, 444773.67, "2024-01-01 02:00", "2024-01-31 01:57")


def test_rounding_is_that_of_the_sql(spark):
    """212.37 / 6.4 lies beside a half in the seventh place; times 1e6 it is below one."""
    import duckdb

    rng = random.Random(9)
    rows = [212.37 / 6.4, 0.5e-6, -0.5e-6, 2.5e-6, 0.49999999999999994e-6, 1e302, 1e303, -1e303, 4503599627370497.5, float("inf"), float("-inf"), 0.0, 1e-9, None]
    rows += [round(rng.uniform(0, 500), 2) / round(rng.uniform(0.1, 9), 1) * rng.choice([1, -1]) for _ in range(2000)] + [rng.randrange(10**9) / 2**k for k in range(8) for _ in range(200)]
    got = [r.v for r in spark.createDataFrame([(v,) for v in rows], "v double").select(S.rounded(F.col("v")).alias("v")).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(unnest($1::DOUBLE[]), 6)", [rows]).fetchall()]
    assert got == want and got[0] == 33.182812
    assert math.isnan(spark.sql("SELECT double('NaN') AS v").select(S.rounded(F.col("v"))).first()[0])
