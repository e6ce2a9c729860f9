"""Streams give what batches give, over any split into files, duplicates and late rows included."""

import random

from pyspark.sql import functions as F

from tests.fixtures import by_formula
from tickforge.functions import scalars as S
from tickforge.operators import ingest
from tickforge.streaming import candles as streams

SCHEMA = "symbol string, open_time_ms long, close double, arrival long"


def land(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in-{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def rows(n=160):
    rng = random.Random(3)
    return [(rng.choice("AB"), rng.randrange(60) * 60_000 + rng.randrange(2), float(i), i) for i in range(n)]


def test_ingest_and_late_rows(spark, tmp_path):
    every = rows()
    every[100:] = [(s, ms % 600_000, c, i) for s, ms, c, i in every[100:]]  # late
    parts = [every[:60], every[60:100], every[100:]]
    stream = land(spark, tmp_path, parts)
    t, strict = (f"{n}_{tmp_path.name}" for n in ("t", "s"))
    streams.start_ingest(stream, t, f"{tmp_path}/c", ["arrival"]).awaitTermination()
    got = {(r.symbol, r.open_time_ms // 60_000): r.close for r in spark.table(t).collect()}
    first = {}
    for s, ms, c, _ in every:
        first.setdefault((s, ms // 60_000), c)
    assert got == first
    batch = ingest.first_of_minute(spark.createDataFrame(every, SCHEMA), ["arrival"])
    assert len(got) == batch.count()
    # the same files again, from a new checkpoint: nothing is added
    streams.start_ingest(stream, t, f"{tmp_path}/c2", ["arrival"]).awaitTermination()
    assert spark.table(t).count() == len(got)
    streams.start_ingest(stream, strict, f"{tmp_path}/c3", ["arrival"], strict=True).awaitTermination()
    want, marks = {}, {}
    for part in parts:
        new = {}
        for s, ms, c, _ in part:
            if ms > marks.get(s, -1):
                new.setdefault((s, ms // 60_000), (ms, c))
        for (s, minute), (ms, c) in new.items():
            if (s, minute) not in want:
                want[s, minute] = c
                marks[s] = max(marks.get(s, -1), ms)
    assert {(r.symbol, r.open_time_ms // 60_000): r.close for r in spark.table(strict).collect()} == want
    assert len(want) < len(got)


def test_scores_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    every = [(s, i * 60_000, 50 + rng.random(), i) for s in "AB" for i in range(400)]
    stream = land(spark, tmp_path, [[r for r in every if a <= r[1] // 60_000 < a + 200] for a in (0, 200)])
    table, scores = (f"{n}_{tmp_path.name}" for n in ("t", "p"))
    streams.start_scoring(stream, table, scores, f"{tmp_path}/c", ["arrival"]).awaitTermination()
    from tickforge.operators import indicators, model

    whole = model.score(indicators.features(spark.createDataFrame(every, SCHEMA).drop("arrival")))
    want = {(r.symbol, r.open_time_ms): r.predicted_proba_spike for r in whole.collect()}
    got = {(r.symbol, r.open_time_ms): r.predicted_proba_spike for r in spark.table(scores).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None and v is None) or abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_look_back_reads_few_days_and_enough_rows(spark, tmp_path):
    """Dense series are read some days back, sparse ones as far as their rows are."""
    name = f"t_{tmp_path.name}"
    ingest.create_if_absent(spark, name)
    dense = [("D", d * 86_400_000 + m * 600_000, 1.0, m) for d in range(40) for m in range(144)]
    thin = [("T", d * 86_400_000, 2.0, 0) for d in range(40)]
    ingest.append_new(name, spark.createDataFrame(dense + thin, SCHEMA), ["arrival"])
    first = spark.createDataFrame([("D", 39 * 86_400_000)], "symbol string, __first long")
    few = streams.recent_rows(spark.table(name), first, 100)
    assert few.count() == 3 * 144 + 12
    first = spark.createDataFrame([("D", 39 * 86_400_000), ("T", 39 * 86_400_000)], "symbol string, __first long")
    assert streams.recent_rows(spark.table(name), first, 30).where("symbol = 'T'").count() >= 31
    assert streams.recent_rows(spark.table(name), first, 5000).where("symbol = 'T'").count() == 40
    assert streams.recent_rows(spark.table(name), first.limit(0), 5).count() == 0


def test_stateful_means(spark, tmp_path):
    import pandas as pd

    rng = random.Random(4)
    series = {s: [50 + rng.random() for _ in range(90)] for s in "AB"}
    every = [(s, i * 60_000, v, i) for s, own in series.items() for i, v in enumerate(own)]
    rng.shuffle(every)
    stream = land(spark, tmp_path, [[r for r in every if a <= r[3] < b] for a, b in ((0, 3), (3, 26), (26, 27), (27, 90))])
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        means = streams.stateful_means(stream.drop("arrival"))
        means.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/m").awaitTermination()
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(f"{tmp_path}/m").orderBy("symbol", "open_time_ms").toPandas()
    for s, own in series.items():
        want, mine = by_formula(pd.Series(own)), got[got["symbol"] == s].reset_index(drop=True)
        for c in ("rsi_backward_14", "macd_diff"):
            assert (mine[c].isna() == want[c].isna()).all() and (mine[c] - want[c]).abs().max() < 1e-9


def test_local_text(spark):
    assert spark.range(1).select(S.local_minute_text(F.lit(0).cast("long"))).first()[0] == "1970-01-01 02:00"


def test_parts_are_landed_by_many_tasks(spark, tmp_path):
    """A large part is several files, by as many tasks, and still a micro-batch of its own; a part of a few rows has as many files; an empty one leaves all at one."""
    rows = spark.range(0, 4000, 1, 3).selectExpr("id", "IF(id % 200 < 3, 1, IF(id % 2 = 0, 0, 2)) AS part")
    want = {k: sorted(r.id for r in rows.where(f"part = {k}").collect()) for k in range(3)}
    for name, parts, most, files in (("many", 3, 250, 7), ("few", 3, 10**6, 1), ("gap", 4, 250, 1)):
        landed, n = streams.land(rows, f"{tmp_path}/{name}", "part", parts, most)
        assert n == files and landed.columns == ["id"]
        seen = {}
        write = lambda b, k: seen.update({k: sorted(r.id for r in b.collect())})  # noqa: B023, E731
        stream = streams.event_stream(spark, f"{tmp_path}/{name}", landed.schema, files=n)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start().awaitTermination()
        assert {k: v for k, v in seen.items() if v} == want
        held = spark.read.parquet(f"{tmp_path}/{name}").groupBy("_metadata.file_path").count().collect()
        assert files == 1 or len(held) == files * parts
