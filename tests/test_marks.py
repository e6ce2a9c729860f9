"""Marks kept by batches, and newest rows read from the newest month back."""

from pyspark.sql import functions as F

from tickforge.operators import fits, ingest, latest, marks, tables
from tickforge.streaming import candles as streams

SCHEMA = "symbol string, open_time_ms long, close double, arrival long"
MINUTE, DAY = 60_000, 86_400_000


def scanned(spark, table):
    return {(r.symbol, r.m, r.n) for r in spark.table(table).groupBy("symbol").agg(F.max("open_time_ms").alias("m"), F.count(F.lit(1)).alias("n")).collect()}


def test_marks_equal_a_scan_after_replays(spark, tmp_path):
    name, folder = f"t_{tmp_path.name}", f"{tmp_path}/marks"
    ingest.create_if_absent(spark, name)
    assert marks.kept_marks(spark, folder).count() == 0
    batches = [[("A", 5 * MINUTE, 1.0, 0), ("B", 0, 1.0, 0)], [("A", 0, 1.0, 0), ("A", 5 * MINUTE, 9.0, 1)], [("C", 40 * DAY, 1.0, 0), ("B", MINUTE, 1.0, 0), ("B", MINUTE + 1, 1.0, 1)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            streams.ingest_batch(spark.createDataFrame(rows, SCHEMA), number, name, f"{tmp_path}/f", ["arrival"], marks=folder)
        assert {tuple(r) for r in marks.kept_marks(spark, folder).collect()} == scanned(spark, name)
    assert {tuple(r) for r in marks.kept_marks(spark, folder, 2).collect()} == {("A", 5 * MINUTE, 2), ("B", 0, 1)}


def test_newest_rows_leave_old_months_alone(spark, tmp_path):
    name, folder = f"t_{tmp_path.name}", f"{tmp_path}/marks"
    ingest.create_if_absent(spark, name)
    rows = [("A", d * DAY, float(d), d) for d in range(400)] + [("B", d * DAY, float(d), d) for d in range(0, 400, 90)] + [("old", 3 * DAY, 1.0, 0)]
    streams.ingest_batch(spark.createDataFrame(rows, SCHEMA), 0, name, f"{tmp_path}/f", ["arrival"], marks=folder)
    kept = marks.kept_marks(spark, folder)
    want = sorted((r.symbol, r.place, r.open_time_ms) for r in latest.newest_per_symbol(spark.table(name), 3).collect())
    assert sorted((r.symbol, r.place, r.open_time_ms) for r in marks.newest_stored(spark, name, kept, 3).collect()) == want and len(want) == 7
    # The dense symbol alone: only the newest month is read, though the other months' files are gone.
    first, gone = spark.table(name).agg(F.max("open_month")).first()[0], 0
    for r in spark.sql(f"SHOW PARTITIONS {name}").collect():
        bucket, month = (x.partition("=")[2] for x in r[0].split("/"))
        if month < first:
            tables.drop(spark, [tables.place_of(spark, name, int(bucket), month)])
            gone += 1
    spark.catalog.refreshTable(name)
    got = marks.newest_stored(spark, name, kept.where("symbol = 'A'"), 3)
    assert gone > 10 and [r.open_time_ms // DAY for r in got.orderBy("place").collect()] == [399, 398, 397]


def test_one_day_is_read_from_few_row_groups(spark, tmp_path):
    """Files are sorted by time, so a range skips what the row groups' bounds leave out."""
    name = f"t_{tmp_path.name}"
    ingest.create_if_absent(spark, name)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("parquet.block.size")
    conf.set("parquet.block.size", str(64 * 1024))
    conf.set("parquet.block.size.row.check.min", "100")
    try:
        rows = spark.range(28 * 1440).selectExpr("'A' AS symbol", f"id * {MINUTE} AS open_time_ms", "rand(1) AS close", "id AS arrival")
        ingest.append_new(name, rows, ["arrival"])
    finally:
        conf.set("parquet.block.size", before) if before else conf.unset("parquet.block.size")
        conf.unset("parquet.block.size.row.check.min")
    one = tables.within(spark.table(name), [("1970-01", 9 * DAY, 10 * DAY - 1)])
    assert one.agg(F.sum("close")).collect() and one.count() == 1440
    held = one.select("open_time_ms", "close")
    plan = held._jdf.queryExecution().executedPlan()
    held._jdf.queryExecution().toRdd().count()
    scan = plan
    while scan.children().size():
        scan = scan.children().apply(0)
    assert 1440 <= scan.metrics().apply("numOutputRows").value() < 28 * 1440 / 4


def test_scores_by_the_newest_fit_before(spark, tmp_path):
    path = f"{tmp_path}/fits"
    kind = "symbol string, status string, n_rows long, b array<double>, se array<double>"
    for ended, rows in ((10, [("A", "converged", 5, [1.0], [0.1]), ("B", "separable", 5, None, None)]), (20, [("A", "converged", 6, [-1.0], [0.1])])):
        for _ in range(2):
            fits.saved_fits(spark.createDataFrame(rows, kind), path, ended)
    rows = spark.createDataFrame([("A", 9, 1.0), ("A", 10, 1.0), ("A", 19, 0.0), ("A", 25, 1.0), ("A", 26, None), ("B", 30, 1.0), ("C", 30, 1.0)], "symbol string, open_time_ms long, x double")
    got = {(r.symbol, r.open_time_ms): (r.ended_ms, r.predicted_proba_spike and round(r.predicted_proba_spike, 6)) for r in fits.score_as_of(rows, fits.fits_of(spark, path), ["x"]).collect()}
    assert got == {("A", 9): (None, None), ("A", 10): (10, 0.731059), ("A", 19): (10, 0.5), ("A", 25): (20, 0.268941), ("A", 26): (20, None), ("B", 30): (None, None), ("C", 30): (None, None)}
