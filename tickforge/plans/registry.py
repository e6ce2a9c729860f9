"""Every registered candle query with its SQL twin. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import indicators as I
from ..operators import fits, gaps, ingest, kept_quantiles, labels, latest, marks, model, tables
from ..operators.blocks import number_rows
from ..sources import candles as C
from ..sources.scratch import shared_dir, stored
from ..streaming import candles as streams
from ..streaming import features as stateful
from ..streaming import ratios
from . import logit_sql as logit_sql_parts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW_MS = 1_706_745_625_000
#: Rows of the first part of the feed, which the stored table holds before the batch comes.
STORED_BEFORE, BATCH_FROM = "2024-01-16 00:00", "2024-01-15 12:00"
#: Event ids of one landed line. Ids are unique, so a line holds at most so many candles, about 100 bytes each.
LINE_IDS = 10_000
#: Parts in which feeds are landed for streams, one micro-batch each.
PARTS = 2


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(C.EVENTS).parquet(f"{sf_dir}/events.parquet")


def offers(found: DataFrame) -> DataFrame:
    return C.from_events(found).withColumn("open_time", S.local_minute_text(F.col("open_time_ms")))


def candles(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """One row a symbol and minute: the first offer, of all events or of those found."""
    rows = offers(events(spark, sf_dir) if found is None else found)
    return ingest.first_of_minute(rows, ["arrival"]).select("symbol", "open_time_ms", "open_time", "close")


def new_table(spark: SparkSession, schema=C.STORED) -> str:
    """An empty table of a fresh name in the shared folder."""
    name = f"t_{uuid.uuid4().hex}"
    ingest.create_if_absent(spark, name, schema, shared_dir(spark, "table"))
    return name


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: S.rounded(F.col(n)) for n in names})


OFFERS_SQL = """
offers AS (
  SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % 60000 AS open_time_ms,
    strftime(make_timestamp((epoch_ms(ts) - epoch_ms(ts) % 60000 + 7200000) * 1000), '%Y-%m-%d %H:%M') AS open_time,
    value AS close, event_id AS arrival FROM events WHERE value IS NOT NULL AND NOT isnan(value)
), candles AS (
  SELECT symbol, open_time_ms, open_time, close FROM offers
  QUALIFY row_number() OVER (PARTITION BY symbol, open_time_ms ORDER BY arrival) = 1
)"""


@query(f"WITH {OFFERS_SQL} SELECT symbol, open_time_ms, open_time, close, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS place FROM candles) WHERE place <= 5")
def q01_latest_n(spark, sf_dir):
    return latest.newest_per_symbol(candles(spark, sf_dir), 5)


@query(f"WITH {OFFERS_SQL} SELECT symbol, open_time, close FROM candles WHERE open_time BETWEEN '2024-01-05 00:00' AND '2024-01-06 00:00'")
def q02_range_scan(spark, sf_dir):
    ends = "2024-01-05 00:00", "2024-01-06 00:00"
    return C.between_text(candles(spark, sf_dir, C.events_between_text(events(spark, sf_dir), *ends)), *ends)


@query(f"""WITH {OFFERS_SQL}, marks AS (SELECT symbol, max(open_time_ms) AS high_water_ms FROM candles GROUP BY symbol
  UNION ALL SELECT 'EMPTY', NULL)
SELECT symbol, coalesce(high_water_ms + 60000, 1483228800000) AS start_ms, ({NOW_MS} - {NOW_MS} % 60000)::BIGINT AS end_ms,
  (coalesce(high_water_ms + 60000, 1483228800000) >= {NOW_MS} - {NOW_MS} % 60000)::INT AS is_empty FROM marks""")
def q03_high_water_mark(spark, sf_dir):
    found = ingest.high_water_mark(candles(spark, sf_dir))
    none = spark.sql("SELECT 'EMPTY' AS symbol, CAST(NULL AS BIGINT) AS high_water_ms")
    return ingest.sync_bounds(found.unionByName(none), NOW_MS).drop("high_water_ms")


def raw_lines(found: DataFrame, *keys: str) -> DataFrame:
    """Events as a landed feed: JSON lines of positional arrays of text, one for each key, user and LINE_IDS event ids (part)."""
    text = lambda c: c.cast("string")
    ms = S.ntz_minute_ms(F.col("ts")) + F.pmod("event_id", F.lit(60_000))
    row = F.array(
        text(ms), text(F.col("value")), F.concat(text(F.col("value")), F.when(F.pmod("event_id", F.lit(3)) == 0, "d").otherwise("")),
        F.col("event_type"), text(F.col("value")), F.when(F.pmod("event_id", F.lit(7)) == 0, "").otherwise(text(F.col("user_id"))),
        *[F.lit("0")] * 6,
    )
    part = (F.col("event_id") - F.pmod("event_id", F.lit(LINE_IDS))).alias("part")
    return found.groupBy(*keys, "user_id", part).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))


@query("""SELECT epoch_ms(ts) - epoch_ms(ts) % 60000 + event_id % 60000 AS open_time_ms,
  strftime(make_timestamp((epoch_ms(ts) - epoch_ms(ts) % 60000 + event_id % 60000 + 7200000) * 1000), '%Y-%m-%d %H:%M') AS open_time,
  round(value, 6) AS open, CASE WHEN event_id % 3 <> 0 THEN round(value, 6) END AS high, CAST(NULL AS DOUBLE) AS low,
  round(value, 6) AS close, CASE WHEN event_id % 7 <> 0 THEN user_id::DOUBLE END AS volume, user_id
FROM events WHERE value IS NOT NULL""")
def q04_normalise_candles(spark, sf_dir):
    good, _ = C.normalise(C.explode_raw(raw_lines(events(spark, sf_dir))), "FEED", ["user_id", "pos"])
    return rounded(good.drop("symbol", "open_date", "pos"), "open", "high", "close")


@query("""SELECT event_id, round(try_cast(CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN '  ' || value::VARCHAR || ' '
  WHEN 2 THEN value::VARCHAR || 'd' ELSE event_type END AS DOUBLE), 6) AS number FROM events""")
def q05_lenient_numeric(spark, sf_dir):
    value, kind = F.col("value").cast("string"), F.pmod("event_id", F.lit(4))
    text = F.when(kind == 0, value).when(kind == 1, F.concat(F.lit("  "), value, F.lit(" "))).when(kind == 2, F.concat(value, F.lit("d"))).otherwise(F.col("event_type"))
    return events(spark, sf_dir).select("event_id", S.rounded(S.lenient_double(text)).alias("number"))


def _synced(spark, sf_dir):
    """A batch, and what of it was new to a stored table that holds the feed's first part."""
    every, table = offers(events(spark, sf_dir)), new_table(spark)
    ingest.append_new(table, every.where(F.col("open_time") < STORED_BEFORE), ["arrival"])
    batch = every.where(F.col("open_time") >= BATCH_FROM)
    return batch, ingest.append_new(table, batch, ["arrival"])


SYNC_SQL = f"""WITH {OFFERS_SQL}, stored AS (SELECT * FROM candles WHERE open_time < '{STORED_BEFORE}'),
batch AS (SELECT * FROM offers WHERE open_time >= '{BATCH_FROM}'),
inserted AS (SELECT symbol, open_time_ms, open_time, close, arrival FROM batch b
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = b.symbol AND s.open_time_ms = b.open_time_ms)
  QUALIFY row_number() OVER (PARTITION BY symbol, open_time_ms ORDER BY arrival) = 1)
"""


@query(SYNC_SQL + "SELECT * FROM inserted")
def q06_insert_or_ignore(spark, sf_dir):
    return _synced(spark, sf_dir)[1].select("symbol", "open_time_ms", "open_time", "close", "arrival")


@query(SYNC_SQL + """SELECT symbol, count(*) AS attempted, (SELECT count(*) FROM inserted i WHERE i.symbol = b.symbol) AS inserted,
  count(*) - (SELECT count(*) FROM inserted i WHERE i.symbol = b.symbol) AS ignored, min(open_time) AS first_time, max(open_time) AS last_time
FROM batch b GROUP BY symbol""")
def q07_sync_report(spark, sf_dir):
    return ingest.sync_report(*_synced(spark, sf_dir))


FORWARD_SQL = """, forward AS (
  SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN CURRENT ROW AND 239 FOLLOWING) AS rolling_max FROM candles
)"""


@query(f"WITH {OFFERS_SQL}{FORWARD_SQL} SELECT * FROM forward")
def q08_forward_max(spark, sf_dir):
    return labels.forward_max(candles(spark, sf_dir))


@query(f"WITH {OFFERS_SQL}{FORWARD_SQL} SELECT * FROM forward")
def q09_forward_max_blocked(spark, sf_dir):
    return labels.forward_max_two_scans(candles(spark, sf_dir))


RATIO_SQL = FORWARD_SQL + """, ratios AS (
  SELECT *, CASE WHEN close = 0 THEN CASE WHEN rolling_max > 0 THEN 'inf'::DOUBLE WHEN rolling_max < 0 THEN '-inf'::DOUBLE END ELSE rolling_max / close END AS ratio FROM forward
), p90s AS (SELECT symbol, quantile_cont(ratio, 0.9) AS p90 FROM ratios GROUP BY symbol),
flags AS (SELECT r.*, p90, coalesce((ratio >= p90)::INT, 0) AS spike_flag FROM ratios r JOIN p90s USING (symbol))"""


@query(f"WITH {OFFERS_SQL}{RATIO_SQL} SELECT symbol, round(p90, 6) AS p90 FROM p90s")
def q10_ratio_p90(spark, sf_dir):
    rated = stored(labels.ratio(labels.forward_max_two_scans(candles(spark, sf_dir))), "rated")
    return rounded(labels.exact_quantile(rated, "ratio", 0.9, "p90"), "p90")


@query(f"WITH {OFFERS_SQL}{RATIO_SQL} SELECT symbol, open_time_ms, open_time, close, rolling_max, round(ratio, 6) AS ratio, round(p90, 6) AS p90, spike_flag FROM flags")
def q11_spike_flag(spark, sf_dir):
    rated = stored(labels.ratio(labels.forward_max_two_scans(candles(spark, sf_dir))), "rated")
    return rounded(labels.spike_flag(rated), "ratio", "p90").select("symbol", "open_time_ms", "open_time", "close", "rolling_max", "ratio", "p90", "spike_flag")


def safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE END ELSE {a} / {b} END"


SERIES = "PARTITION BY symbol ORDER BY open_time_ms"


def frames_sql() -> str:
    lagged = [f"lag(close, {k}) OVER (w) AS lag_{k}" for k in (14, 140)]
    made = [
        f"CASE WHEN count(close) OVER t{k} >= {k} THEN avg(close) OVER t{k} END AS avg_{k}, CASE WHEN count(close) OVER t{k} >= {k} THEN stddev_pop(close) OVER t{k} END AS std_{k}"
        for k in (14, 140)
    ]
    windows = ", ".join(f"t{k} AS ({SERIES} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (14, 140))
    out = []
    for k in (14, 140):
        out += [f"100 * ({safe(f'(close - lag_{k})', f'lag_{k}')}) AS roc_{k}", safe("close", f"avg_{k}") + f" AS sma_ratio_{k}", safe(f"400 * std_{k}", f"avg_{k}") + f" AS bb_width_{k}"]
    lagged = ", ".join(lagged).replace("(w)", f"({SERIES})")
    return f""", parts AS (SELECT *, {lagged}, {", ".join(made)} FROM candles WINDOW {windows}),
frames AS (SELECT symbol, open_time_ms, {", ".join(out)} FROM parts)"""


FRAMES_SQL = frames_sql()


def _indicator(kinds: tuple[str, ...]):
    def run(spark, sf_dir):
        spec = tuple(s for s in I.DEFAULT_SPEC if s.kind in kinds)
        made = I.features(candles(spark, sf_dir), spec)
        return rounded(made, *[s.column for s in spec]).select("symbol", "open_time_ms", *[s.column for s in spec])

    return run


for _name, _kind in (("q12_roc", "roc"), ("q13_sma_ratio", "sma_ratio"), ("q14_bb_width", "bb_width")):
    QUERIES[_name] = _indicator((_kind,))
    ORACLE_SQL[_name] = f"WITH {OFFERS_SQL}{FRAMES_SQL} SELECT symbol, open_time_ms, round({_kind}_14, 6) AS {_kind}_14, round({_kind}_140, 6) AS {_kind}_140 FROM frames"

#: One recursion carries every mean from row to row of all symbols.
MEANS_SQL = """, placed AS (
  SELECT symbol, open_time_ms, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS i,
    coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time_ms), 0) AS move FROM candles
), means AS (
  SELECT symbol, i, close AS ema, greatest(move, 0.0::DOUBLE) AS gain, greatest(-move, 0.0::DOUBLE) AS loss, close AS fast, close AS slow, NULL::DOUBLE AS signal FROM placed WHERE i = 0
  UNION ALL
  SELECT p.symbol, p.i, 0.2 * p.close + (1 - 0.2) * m.ema,
    greatest(p.move, 0.0::DOUBLE) / 14 + (1 - 1.0::DOUBLE / 14) * m.gain, greatest(-p.move, 0.0::DOUBLE) / 14 + (1 - 1.0::DOUBLE / 14) * m.loss,
    2.0::DOUBLE / 13 * p.close + 11.0::DOUBLE / 13 * m.fast, 2.0::DOUBLE / 27 * p.close + 25.0::DOUBLE / 27 * m.slow,
    CASE WHEN p.i < 25 THEN NULL WHEN p.i = 25 THEN 2.0::DOUBLE / 13 * p.close + 11.0::DOUBLE / 13 * m.fast - (2.0::DOUBLE / 27 * p.close + 25.0::DOUBLE / 27 * m.slow)
      ELSE 0.2 * (2.0::DOUBLE / 13 * p.close + 11.0::DOUBLE / 13 * m.fast - (2.0::DOUBLE / 27 * p.close + 25.0::DOUBLE / 27 * m.slow)) + 0.8 * m.signal END
  FROM means m JOIN placed p ON p.symbol = m.symbol AND p.i = m.i + 1
), recurrences AS (
  SELECT p.symbol, p.open_time_ms, m.ema, CASE WHEN p.i >= 13 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi_backward_14,
    CASE WHEN p.i >= 33 THEN fast - slow - signal END AS macd_diff
  FROM means m JOIN placed p ON p.symbol = m.symbol AND p.i = m.i
)"""
RECURSIVE = f"WITH RECURSIVE {OFFERS_SQL}{MEANS_SQL}"


@query(f"{RECURSIVE} SELECT symbol, open_time_ms, round(ema, 6) AS ema FROM recurrences")
def q15_ema(spark, sf_dir):
    return rounded(I.exponential_mean(candles(spark, sf_dir), 0.2), "ema").select("symbol", "open_time_ms", "ema")


QUERIES["q16_rsi"] = _indicator(("rsi",))
ORACLE_SQL["q16_rsi"] = f"{RECURSIVE} SELECT symbol, open_time_ms, round(rsi_backward_14, 6) AS rsi_backward_14 FROM recurrences"
QUERIES["q17_macd_diff"] = _indicator(("macd_diff",))
ORACLE_SQL["q17_macd_diff"] = f"{RECURSIVE} SELECT symbol, open_time_ms, round(macd_diff, 6) AS macd_diff FROM recurrences"

MATRIX_SQL = f"""{RECURSIVE}{FRAMES_SQL}{RATIO_SQL}, matrix AS (
  SELECT f.symbol, f.open_time_ms, f.open_time, f.close, f.rolling_max, f.ratio, f.spike_flag, {", ".join(model.FEATURES)}
  FROM flags f JOIN frames USING (symbol, open_time_ms) JOIN recurrences USING (symbol, open_time_ms)
), sample AS (
  SELECT m.* FROM matrix m JOIN (SELECT symbol, max(open_time_ms) AS newest FROM matrix WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*model.FEATURES, "ratio"))} GROUP BY symbol) USING (symbol)
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*model.FEATURES, "ratio"))} AND open_time_ms < newest - 14400000
)"""
ROUNDED_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ("ratio", *model.FEATURES))


def matrix(spark, sf_dir) -> DataFrame:
    rows = stored(number_rows(candles(spark, sf_dir)), "numbered")
    flagged = labels.spike_flag(stored(labels.ratio(labels.forward_max_two_scans(rows)), "labelled")).drop("p90")
    return I.features(flagged).drop("__i")


@query(f"{MATRIX_SQL} SELECT symbol, open_time_ms, open_time, close, rolling_max, spike_flag, {ROUNDED_SQL} FROM matrix")
def q18_feature_matrix(spark, sf_dir):
    return rounded(matrix(spark, sf_dir), "ratio", *model.FEATURES)


@query(f"{MATRIX_SQL} SELECT symbol, open_time_ms, open_time, close, rolling_max, spike_flag, {ROUNDED_SQL} FROM sample")
def q19_training_sample(spark, sf_dir):
    return rounded(model.training_sample(stored(matrix(spark, sf_dir), "matrix")), "ratio", *model.FEATURES)


def logit_sql() -> str:
    finite = " AND ".join(f"abs({c}) < 'inf'::DOUBLE" for c in model.FEATURES)
    return f"""{MATRIX_SQL}, told AS (SELECT *, {finite} AS finite FROM sample), used AS MATERIALIZED (SELECT * FROM told WHERE finite),
{logit_sql_parts.fitted("used", "spike_flag", model.FEATURES)}
SELECT t.*, (SELECT count(*) FROM used) AS n_rows, (SELECT count(*) FROM told WHERE NOT finite) AS n_not_finite
FROM ({logit_sql_parts.coefficient_table(model.FEATURES, model.Z95)}) t"""


@query(logit_sql())
def q20_logit_table(spark, sf_dir):
    """The fit over rows with finite features. n_rows: the rows that it saw, n_not_finite: those of q19's sample left out."""
    sample = stored(model.training_sample(stored(matrix(spark, sf_dir), "matrix")), "sample")
    finite = model.all_finite()
    counts = sample.agg(F.count_if(finite).alias("n_rows"), F.count_if(~finite).alias("n_not_finite")).first().asDict()
    used = sample.where(finite)
    found = rounded(model.coefficient_table(model.fit_logit(used), used), "coef", "std_err", "z", "p_value", "ci_low", "ci_high")
    return found.withColumns({c: F.lit(n).cast("long") for c, n in counts.items()})


SCORE_SQL = f"1 / (1 + exp(-({' + '.join(f'({v!r}) * {k}' for k, v in model.FROZEN.items())})))"


@query(f"""{MATRIX_SQL}, scored AS (SELECT symbol, open_time_ms, {SCORE_SQL} AS p FROM matrix)
SELECT symbol, open_time_ms, round(p, 6) AS predicted_proba_spike, CASE WHEN p < 0.01 THEN 'short' WHEN p > 0.1 THEN 'long' WHEN p IS NOT NULL THEN 'flat' END AS signal_band FROM scored""")
def q21_score_bands(spark, sf_dir):
    scored = model.score(I.features(candles(spark, sf_dir))).withColumn("signal_band", model.signal_band())
    return rounded(scored, "predicted_proba_spike").select("symbol", "open_time_ms", "predicted_proba_spike", "signal_band")


def by_time(rows: DataFrame, ms: Column, parts: int = PARTS) -> DataFrame:
    """rows with the part of their day among `parts` equal runs of days: a minute lies in one of them."""
    day = F.floor(ms / 86_400_000)
    first, last = rows.agg(F.min(day), F.max(day)).first()
    step = ((last or 0) - (first or 0)) // parts + 1
    return rows.withColumn("__part", F.floor((day - F.lit(first or 0)) / step))


def _stream(spark, rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of the rows (with __part), a micro-batch for each part."""
    folder = shared_dir(spark, "landed")
    landed, files = streams.land(rows, folder, "__part", parts)
    return streams.event_stream(spark, folder, landed.schema, files=files)


def _events_by_time(spark, sf_dir) -> DataFrame:
    return by_time(events(spark, sf_dir), S.ntz_minute_ms(F.col("ts")))


@query(f"WITH {OFFERS_SQL} SELECT symbol, open_time_ms, close FROM candles")
def q22_stream_ingest(spark, sf_dir):
    table, feed = new_table(spark), C.from_events(_stream(spark, _events_by_time(spark, sf_dir)))
    streams.start_ingest(feed, table, shared_dir(spark, "log"), ["arrival"]).awaitTermination()
    return spark.table(table).select("symbol", "open_time_ms", "close")


@query(f"{MATRIX_SQL} SELECT symbol, open_time_ms, close, round({SCORE_SQL}, 6) AS predicted_proba_spike FROM matrix")
def q23_stream_score(spark, sf_dir):
    table, scores = new_table(spark), new_table(spark, streams.SCORES)
    feed = C.from_events(_stream(spark, _events_by_time(spark, sf_dir)))
    streams.start_scoring(feed, table, scores, shared_dir(spark, "log"), ["arrival"]).awaitTermination()
    return rounded(spark.table(scores).drop("open_date", "bucket", "open_month"), "predicted_proba_spike")


@query(f"{RECURSIVE} SELECT symbol, open_time_ms, round(rsi_backward_14, 6) AS rsi_backward_14, round(macd_diff, 6) AS macd_diff FROM recurrences")
def q24_stateful_means(spark, sf_dir):
    """The recurrences carried as streaming state from batch to batch. The feed is landed as deduplicated candles by time."""
    rows = by_time(candles(spark, sf_dir).select("symbol", "open_time_ms", "close"), F.col("open_time_ms"))
    return rounded(_with_state(spark, streams.stateful_means(_stream(spark, rows))), "rsi_backward_14", "macd_diff").drop("close")


def _with_state(spark, made: DataFrame) -> DataFrame:
    """What a stream with state writes until its feed is read."""
    base, name = shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = made.writeStream.format("parquet").option("checkpointLocation", f"{base}/log")
        writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(made.schema).parquet(f"{base}/out")


LATE_SQL = """WITH fed AS (
  SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % 60000 AS open_time_ms, value AS close, event_id AS arrival, user_id % 2 AS part FROM events WHERE value IS NOT NULL AND NOT isnan(value)
), marks AS (SELECT symbol, max(open_time_ms) AS mark FROM fed WHERE part = 0 GROUP BY symbol),
told AS (
  SELECT 'lenient' AS mode, * FROM fed UNION ALL
  SELECT 'strict', f.* FROM fed f LEFT JOIN marks m ON m.symbol = f.symbol WHERE part = 0 OR mark IS NULL OR open_time_ms > mark
)
SELECT mode, symbol, open_time_ms, close FROM told QUALIFY row_number() OVER (PARTITION BY mode, symbol, open_time_ms ORDER BY part, arrival) = 1"""


@query(LATE_SQL)
def q25_stream_late_rows(spark, sf_dir):
    """Half of the users' events come late: they fill gaps, or, in strict mode, only what is newer than all before."""
    rows = events(spark, sf_dir).withColumn("__part", F.pmod("user_id", F.lit(2)))
    feed, found = C.from_events(_stream(spark, rows)), []
    for mode in ("lenient", "strict"):
        table = new_table(spark)
        streams.start_ingest(feed, table, shared_dir(spark, "log"), ["arrival"], strict=mode == "strict").awaitTermination()
        found.append(spark.table(table).select(F.lit(mode).alias("mode"), "symbol", "open_time_ms", "close"))
    return found[0].unionByName(found[1])


FETCH_NOW_MS = 1_706_400_030_000


@query(f"""WITH raw AS (SELECT *, epoch_ms(ts) - epoch_ms(ts) % 60000 AS minute FROM events WHERE value IS NOT NULL)
SELECT minute + event_id % 60000 AS open_time_ms, round(value, 6) AS open, CASE WHEN event_id % 3 <> 0 THEN round(value, 6) END AS high,
  round(value, 6) AS close, CASE WHEN event_id % 7 <> 0 THEN user_id::DOUBLE END AS volume
FROM raw WHERE minute < {FETCH_NOW_MS} - {FETCH_NOW_MS} % 60000
QUALIFY row_number() OVER (PARTITION BY minute ORDER BY event_id - event_id % {LINE_IDS}, user_id, event_id % 60000) = 1""")
def q26_raw_sync(spark, sf_dir):
    """The sync from end to end: bounds of the next fetch, raw lines as they land, normalised, cut to the bounds, stored."""
    table = new_table(spark)
    asked = spark.createDataFrame([("FEED",)], "symbol string").join(ingest.high_water_mark(spark.table(table)), "symbol", "left")
    bounds = ingest.sync_bounds(asked, FETCH_NOW_MS).first()
    lines = _stream(spark, raw_lines(_events_by_time(spark, sf_dir), "__part"))
    arrival = ["part", "user_id", "pos"]
    good, _ = C.normalise(C.explode_raw(lines), "FEED", arrival)
    streams.start_ingest(C.between(good, bounds["start_ms"], bounds["end_ms"]), table, shared_dir(spark, "log"), arrival).awaitTermination()
    return rounded(spark.table(table), "open", "high", "close").select("open_time_ms", "open", "high", "close", "volume")


@query(SYNC_SQL + "SELECT symbol, open_time_ms, open_time, close FROM batch QUALIFY row_number() OVER (PARTITION BY symbol, open_time_ms ORDER BY arrival) = 1")
def q27_table_reset(spark, sf_dir):
    """A table that is made once, filled, emptied by name and filled again."""
    every, table = offers(events(spark, sf_dir)), new_table(spark)
    ingest.append_new(table, every.where(F.col("open_time") < STORED_BEFORE), ["arrival"])
    ingest.create_if_absent(spark, table)
    ingest.reset(spark, table)
    ingest.append_new(table, every.where(F.col("open_time") >= BATCH_FROM), ["arrival"])
    return spark.table(table).select("symbol", "open_time_ms", "open_time", "close")


@query(f"""WITH {OFFERS_SQL}, top AS (SELECT * FROM candles ORDER BY open_time_ms DESC, open_time DESC, symbol DESC LIMIT 5)
SELECT 'newest' AS list, row_number() OVER (ORDER BY open_time_ms DESC, open_time DESC, symbol DESC)::INT AS place, symbol, close, strptime(open_time, '%Y-%m-%d %H:%M')::VARCHAR AS opened FROM top
UNION ALL SELECT 'tail', row_number() OVER (ORDER BY open_time_ms, open_time, symbol)::INT, symbol, close, strptime(open_time, '%Y-%m-%d %H:%M')::VARCHAR FROM top""")
def q28_newest(spark, sf_dir):
    rows, key = candles(spark, sf_dir), ["open_time_ms", "open_time", "symbol"]
    found = []
    for name, few, order in (("newest", latest.newest(rows, 5), F.desc), ("tail", latest.tail(rows, 5), F.asc)):
        place = F.row_number().over(Window.partitionBy("list").orderBy(*map(order, key)))
        found.append(few.withColumn("list", F.lit(name)).withColumn("place", place))
    both = found[0].unionByName(found[1])
    return both.select("list", "place", "symbol", "close", S.local_text_to_ntz(F.col("open_time")).cast("string").alias("opened"))


BAD_FEED_SQL = f"""fed AS (
  SELECT event_type AS symbol, CASE WHEN event_id % 13 <> 0 THEN epoch_ms(ts) - epoch_ms(ts) % 60000 + event_id % 60000 END AS ms,
    CASE WHEN event_id % 11 <> 0 AND NOT isnan(value) THEN value END AS close, event_id - event_id % {LINE_IDS} AS line, user_id, event_id,
    epoch_ms(ts) // 86400000 AS day FROM events
), days AS (SELECT min(day) AS a, (max(day) - min(day)) // {PARTS} + 1 AS step FROM fed),
judged AS (SELECT *, ((day - a) // step)::BIGINT AS batch, ms IS NOT NULL AND close IS NOT NULL AS good FROM fed, days),
told AS (
  SELECT *, good AND row_number() OVER (PARTITION BY symbol, ms - ms % 60000, good ORDER BY batch, line, user_id, event_id % 60000) = 1 AS won,
    CASE WHEN good THEN strftime(make_timestamp((ms - ms % 60000 + 7200000) * 1000), '%Y-%m-%d %H:%M') END AS minute FROM judged
)"""


@query(f"""WITH {BAD_FEED_SQL} SELECT batch, symbol, count(*) FILTER (WHERE good) AS attempted, count(*) FILTER (WHERE won) AS inserted,
  count(*) FILTER (WHERE good AND NOT won) AS ignored, count(*) FILTER (WHERE NOT good) AS rejected, min(minute) AS first_time, max(minute) AS last_time
FROM told GROUP BY batch, symbol""")
def q29_stream_report(spark, sf_dir):
    """The report of every micro-batch of a raw feed in which some rows have no time or no close."""
    bad = _events_by_time(spark, sf_dir).withColumns({
        "value": F.when(F.pmod("event_id", F.lit(11)) != 0, F.nanvl("value", F.lit(None))), "ts": F.when(F.pmod("event_id", F.lit(13)) != 0, F.col("ts")),
    })
    lines, arrival = _stream(spark, raw_lines(bad, "__part", "event_type")), ["part", "user_id", "pos"]
    report = shared_dir(spark, "report")
    feed = C.judged(C.explode_raw(lines), F.col("event_type"), arrival)
    streams.start_ingest(feed, new_table(spark), shared_dir(spark, "log"), arrival, report=report).awaitTermination()
    return streams.batch_report(spark, report)


LATE_OFFERS_SQL = OFFERS_SQL.replace("event_id AS arrival FROM", "event_id AS arrival, user_id % 2 AS part FROM").replace("ORDER BY arrival", "ORDER BY part, arrival")


@query(f"{MATRIX_SQL.replace(OFFERS_SQL, LATE_OFFERS_SQL)} SELECT symbol, open_time_ms, close, round({SCORE_SQL}, 6) AS predicted_proba_spike FROM matrix")
def q30_score_repair(spark, sf_dir):
    """Half of the users' events come late; the scores are those of all candles, as if none had."""
    table, scores = new_table(spark), new_table(spark, streams.SCORES)
    feed = C.from_events(_stream(spark, events(spark, sf_dir).withColumn("__part", F.pmod("user_id", F.lit(2)))))
    streams.start_scoring(feed, table, scores, shared_dir(spark, "log"), ["arrival"]).awaitTermination()
    return rounded(spark.table(scores).select("symbol", "open_time_ms", "close", "predicted_proba_spike"), "predicted_proba_spike")


@query(f"WITH {OFFERS_SQL} SELECT symbol, open_time_ms, open_time, close FROM candles")
def q31_compacted_table(spark, sf_dir):
    """Six appends leave six files in a partition; packed, the table has the same rows in one each."""
    table, rows = new_table(spark), candles(spark, sf_dir).withColumn("arrival", F.lit(0))
    landed = stored(by_time(rows, F.col("open_time_ms"), 6), "landed")
    for k in range(6):
        ingest.append_new(table, landed.where(F.col("__part") == k).drop("__part"), ["arrival"])
    tables.compact(spark, table)
    return spark.table(table).select("symbol", "open_time_ms", "open_time", "close")


#: A feed of three parts by days. Some rows of a part's last two hours come in the next part, which the watermark's delay allows for; some of the
#: first part come in the third, when it has long passed them.
DISORDER, DELAY_MS = 3, 3 * 3_600_000
DISORDER_SQL = OFFERS_SQL.replace("candles AS (", "every AS (") + f""", days AS (
  SELECT min(open_time_ms // 86400000) AS a, (max(open_time_ms // 86400000) - min(open_time_ms // 86400000)) // {DISORDER} + 1 AS step FROM every
), timed AS (SELECT *, (open_time_ms // 86400000 - a) // step AS own, open_time_ms // 60000 AS m, (a + ((open_time_ms // 86400000 - a) // step + 1) * step) * 86400000 AS stop FROM every, days),
fed AS (SELECT *, CASE WHEN own = 0 AND m % 97 = 5 THEN 2 WHEN own < 2 AND m % 7 = 0 AND open_time_ms >= stop - 7200000 THEN own + 1 ELSE own END AS part FROM timed),
judged AS (SELECT f.*, coalesce(open_time_ms < (SELECT max(open_time_ms) FROM fed g WHERE g.part < f.part) - {DELAY_MS}, false) AS late FROM fed f),
candles AS (SELECT symbol, open_time_ms, open_time, close FROM judged WHERE NOT late)"""


@query(f"""WITH RECURSIVE {DISORDER_SQL}{MEANS_SQL}{FRAMES_SQL}
SELECT symbol, open_time_ms, close, 0 AS late, {", ".join(f"round({c}, 6) AS {c}" for c in model.FEATURES)}
FROM candles JOIN frames USING (symbol, open_time_ms) JOIN recurrences USING (symbol, open_time_ms)
UNION ALL SELECT symbol, open_time_ms, close, 1, {", ".join(["NULL"] * len(model.FEATURES))} FROM judged WHERE late""")
def q32_stream_features(spark, sf_dir):
    """All eight features as state, from rows out of order in three micro-batches; late rows are told apart. A clock tick ends the feed."""
    rows = by_time(candles(spark, sf_dir).select("symbol", "open_time_ms", "close"), F.col("open_time_ms"), DISORDER)
    rows = stored(rows.withColumn("arrival", F.lit(0).cast("long")), "to-disorder")
    ms, own = F.col("open_time_ms"), F.col("__part")
    first, newest = rows.agg(F.min(F.floor(ms / 86_400_000)), F.max("open_time_ms")).first()
    step = (newest // 86_400_000 - first) // DISORDER + 1 if newest is not None else 1
    stop = (F.lit(first or 0) + (own + 1) * step) * 86_400_000
    minute = F.floor(ms / 60_000)
    part = F.when((own == 0) & (minute % 97 == 5), 2).when((own < 2) & (minute % 7 == 0) & (ms >= stop - 7_200_000), own + 1).otherwise(own)
    tick = spark.range(1).select(
        F.lit("clock").alias("symbol"), F.lit((newest or 0) + 86_400_000).cast("long").alias("open_time_ms"), F.lit(None).cast("double").alias("close"),
        F.lit(0).cast("long").alias("arrival"), F.lit(DISORDER).cast("long").alias("__part"),
    )
    feed = _stream(spark, rows.withColumn("__part", part.cast("long")).unionByName(tick), DISORDER + 1)
    made = _with_state(spark, stateful.stream_features(feed, f"{DELAY_MS} milliseconds"))
    return rounded(made.withColumn("late", F.col("late").cast("int")), *model.FEATURES)


#: What is stored before the sync, by the symbol's place in the alphabet: nothing, so many days, and the last symbol all there is to fetch.
KNOWN_DAYS = 5
SYNC_MANY_SQL = f"""WITH {OFFERS_SQL}, symbols AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT symbol FROM offers)),
bound AS (SELECT {FETCH_NOW_MS} - {FETCH_NOW_MS} % 60000 AS stop, (SELECT min(open_time_ms) // 86400000 FROM offers) * 86400000 AS begun),
known AS (
  SELECT symbol, open_time_ms FROM offers JOIN symbols USING (symbol), bound WHERE k > 0 AND k < n - 1 AND open_time_ms < begun + k * {KNOWN_DAYS} * 86400000
  UNION ALL SELECT symbol, stop - 60000 FROM symbols, bound WHERE k = n - 1
), bounds AS (
  SELECT symbol, coalesce(max(open_time_ms) + 60000, 1483228800000) AS start_ms, any_value(stop) AS end_ms FROM (SELECT symbol FROM symbols UNION ALL SELECT 'EMPTY') LEFT JOIN known USING (symbol), bound GROUP BY symbol
), came AS (SELECT o.* FROM offers o JOIN bounds USING (symbol) WHERE open_time_ms >= start_ms AND open_time_ms < end_ms)"""


@query(f"""{SYNC_MANY_SQL} SELECT symbol, start_ms, end_ms, (start_ms >= end_ms)::INT AS is_empty, count(c.arrival) AS attempted, count(DISTINCT c.open_time_ms) AS inserted,
  count(c.arrival) - count(DISTINCT c.open_time_ms) AS ignored, min(c.open_time) AS first_time, max(c.open_time) AS last_time
FROM bounds LEFT JOIN came c USING (symbol) GROUP BY ALL""")
def q33_sync_many(spark, sf_dir):
    """One sync of symbols that are known to different times: one not at all, one up to date, one without rows to fetch."""
    landing = new_table(spark, T.StructType([T.StructField("arrival", T.LongType()), *C.STORED.fields]))
    every = offers(events(spark, sf_dir))
    tables.append(C.as_stored(every, "arrival"), landing)
    table, rows = new_table(spark), spark.table(landing)
    begun = S.MINUTE_MS * 1440 * (rows.agg(F.min(F.floor(F.col("open_time_ms") / 86_400_000))).first()[0] or 0)
    symbols = sorted(r[0] for r in rows.select("symbol").distinct().collect())
    known = {s: begun + k * KNOWN_DAYS * 86_400_000 for k, s in enumerate(symbols[:-1]) if k}
    limits = spark.createDataFrame(list(known.items()), "symbol string, known long")
    stop = FETCH_NOW_MS - FETCH_NOW_MS % S.MINUTE_MS
    last = spark.createDataFrame([(s, stop - S.MINUTE_MS, 0.0, -1) for s in symbols[-1:]], "symbol string, open_time_ms long, close double, arrival long")
    before = every.join(F.broadcast(limits), "symbol").where("open_time_ms < known").select(*last.columns)
    ingest.append_new(table, before.unionByName(last), ["arrival"])
    asked = spark.createDataFrame([(s,) for s in [*symbols, "EMPTY"]], "symbol string")
    bounds = stored(ingest.sync_bounds(asked.join(ingest.high_water_mark(spark.table(table)), "symbol", "left"), FETCH_NOW_MS), "bounds")
    came = stored(ingest.fetch(rows, bounds), "fetched")
    report = ingest.sync_report(came, ingest.append_new(table, came, ["arrival"]))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("attempted", "inserted", "ignored")}
    return bounds.drop("high_water_ms").join(report, "symbol", "left").withColumns(zero)


GAPS_SQL = f"""WITH RECURSIVE {OFFERS_SQL}, holed AS (
  SELECT symbol, open_time_ms, CASE WHEN open_time_ms // 60000 % 7 < 2 OR open_time_ms // 86400000 % 5 = 1 THEN NULL ELSE close END AS close FROM candles
), placed AS (
  SELECT symbol, open_time_ms, close, row_number() OVER w - 1 AS i, coalesce(close - lag(close) OVER w, 0) AS move, count(close) OVER w AS n FROM holed WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)
), means AS (
  SELECT symbol, i, close AS ema, close AS fast, close AS slow, 0::BIGINT AS since, greatest(move, 0.0::DOUBLE) AS gain, greatest(-move, 0.0::DOUBLE) AS loss, NULL::DOUBLE AS signal, 0::BIGINT AS told FROM placed WHERE i = 0
  UNION ALL
  SELECT symbol, i, ema, fast, slow, CASE WHEN close IS NULL THEN since + 1 ELSE 0 END, gain, loss,
    CASE WHEN n < 26 THEN NULL WHEN signal IS NULL THEN fast - slow ELSE 0.2 * (fast - slow) + 0.8 * signal END, CASE WHEN n < 26 THEN 0 ELSE told + 1 END
  FROM (SELECT p.symbol, p.i, p.close, p.n, m.since, m.signal, m.told, {{means}},
      greatest(p.move, 0.0::DOUBLE) / 14 + (1 - 1.0::DOUBLE / 14) * m.gain AS gain, greatest(-p.move, 0.0::DOUBLE) / 14 + (1 - 1.0::DOUBLE / 14) * m.loss AS loss
    FROM means m JOIN placed p ON p.symbol = m.symbol AND p.i = m.i + 1)
)
SELECT p.symbol, p.open_time_ms, round(ema, 6) + 0.0::DOUBLE AS ema, round(CASE WHEN p.i >= 13 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END, 6) + 0.0::DOUBLE AS rsi,
  round(CASE WHEN told >= 9 THEN fast - slow - signal END, 6) + 0.0::DOUBLE AS macd_diff FROM means m JOIN placed p ON p.symbol = m.symbol AND p.i = m.i"""
_weighed = lambda name, a: (
    f"CASE WHEN p.close IS NULL THEN m.{name} WHEN m.{name} IS NULL THEN p.close ELSE (pow(1 - {a}, m.since + 1) * m.{name} + {a} * p.close) / (pow(1 - {a}, m.since + 1) + {a}) END AS {name}"
)
GAPS_SQL = GAPS_SQL.replace("{means}", ", ".join(_weighed(n, a) for n, a in (("ema", "0.2::DOUBLE"), ("fast", "(2.0::DOUBLE / 13)"), ("slow", "(2.0::DOUBLE / 27)"))))


@query(GAPS_SQL)
def q34_gap_means(spark, sf_dir):
    """Means, RSI and MACD of series in which two minutes of seven and every fifth day have no close."""
    ms = F.col("open_time_ms")
    gone = (F.floor(ms / 60_000) % 7 < 2) | (F.floor(ms / 86_400_000) % 5 == 1)
    rows = candles(spark, sf_dir).select("symbol", "open_time_ms", F.when(~gone, F.col("close")).alias("close"))
    rows = stored(number_rows(rows), "numbered")
    made = rounded(gaps.gap_macd_diff(gaps.gap_rsi(gaps.gap_mean(rows, 0.2))), "ema", "rsi", "macd_diff")
    return made.select("symbol", "open_time_ms", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("ema", "rsi", "macd_diff")])  # -0.0 is 0.0


FINITE_SQL = " AND ".join(f"abs({c}) < 'inf'::DOUBLE" for c in model.FEATURES)


@query(f"""{MATRIX_SQL}, used AS MATERIALIZED (SELECT * FROM sample WHERE {FINITE_SQL}), {logit_sql_parts.fitted_by("used", "spike_flag", model.FEATURES)}
SELECT s.symbol, CASE WHEN term IS NULL THEN 'separable' ELSE 'converged' END AS status, n_rows, t.* EXCLUDE (symbol)
FROM (SELECT symbol, count(*) AS n_rows FROM used GROUP BY symbol) s LEFT JOIN ({logit_sql_parts.terms_by(model.FEATURES, model.Z95)}) t ON t.symbol = s.symbol""")
def q35_fit_by_symbol(spark, sf_dir):
    """The logistic fit of every symbol by itself; one whose labels can be told apart has a row that says so."""
    found = fits.fit_table(fits.fit_by_symbol(model.training_sample(stored(matrix(spark, sf_dir), "matrix"))))
    return rounded(found, "coef", "std_err", "z", "p_value", "ci_low", "ci_high")


TRAIN_SQL = MATRIX_SQL + f""", levels AS (SELECT symbol, quantile_cont(ratio, 0.9) AS level FROM sample GROUP BY symbol)"""


@query(f"""{TRAIN_SQL} SELECT symbol, open_time_ms, round(ratio, 6) AS ratio, round(level, 6) AS p90, coalesce((ratio >= level)::INT, 0) AS spike_flag
FROM matrix LEFT JOIN levels USING (symbol)""")
def q36_train_threshold(spark, sf_dir):
    """The flag whose threshold comes from the training rows alone."""
    whole = stored(matrix(spark, sf_dir), "matrix")
    flagged = labels.spike_flag(whole.drop("spike_flag"), scope=model.training_sample(whole))
    return rounded(flagged.select("symbol", "open_time_ms", "ratio", "p90", "spike_flag"), "ratio", "p90")


#: Days from the first one after which the model is fitted anew.
REFITS = (12, 20)


def _known_by(cut: str) -> str:
    """The fits of all symbols from what was known before a time, as rows (symbol, ended_ms, b0, ...)."""
    candles_then = OFFERS_SQL + f", known AS (SELECT * FROM candles WHERE open_time_ms < {cut})"
    rest = MATRIX_SQL[len(RECURSIVE) - len(MEANS_SQL):].replace("FROM candles", "FROM known")
    return f"""WITH RECURSIVE {candles_then}{rest}, levels AS (SELECT symbol, quantile_cont(ratio, 0.9) AS level FROM sample GROUP BY symbol),
    used AS MATERIALIZED (SELECT s.*, coalesce((ratio >= level)::INT, 0) AS told FROM sample s JOIN levels USING (symbol) WHERE {FINITE_SQL}),
    {logit_sql_parts.fitted_by("used", "told", model.FEATURES)} SELECT best.*, {cut} AS ended_ms FROM best JOIN fine USING (symbol)"""


def walk_forward_sql() -> str:
    cuts = [f"((SELECT min(open_time_ms) // 86400000 FROM offers) + {d}) * 86400000" for d in REFITS]
    runs = ", ".join(f"run{k} AS MATERIALIZED ({_known_by(c)})" for k, c in enumerate(cuts))
    every = " UNION ALL ".join(f"SELECT * FROM run{k}" for k in range(len(cuts)))
    p = f"1 / (1 + exp(-({' + '.join(f'b{i} * {c}' for i, c in enumerate(model.FEATURES))})))"
    return f"""WITH RECURSIVE {runs}, fits AS ({every}), {MATRIX_SQL.removeprefix("WITH RECURSIVE ")}
SELECT m.symbol, m.open_time_ms, f.ended_ms::BIGINT AS ended_ms, round({p}, 6) AS predicted_proba_spike FROM matrix m LEFT JOIN fits f ON f.symbol = m.symbol AND f.ended_ms = (
  SELECT max(g.ended_ms) FROM fits g WHERE g.symbol = m.symbol AND g.ended_ms <= m.open_time_ms)"""


@query(walk_forward_sql())
def q37_walk_forward(spark, sf_dir):
    """Two runs fit each symbol from what was known then, thresholds from their training rows; each candle is scored by the newest one before it."""
    rows, path = stored(candles(spark, sf_dir), "candles"), shared_dir(spark, "fits")
    first = rows.agg(F.min(F.floor(F.col("open_time_ms") / 86_400_000))).first()[0] or 0
    for days in REFITS:
        ended = (first + days) * 86_400_000
        rated = stored(labels.ratio(labels.forward_max_two_scans(rows.where(F.col("open_time_ms") < ended))), "labelled")
        known = stored(I.features(rated), "matrix")
        flagged = labels.spike_flag(known, scope=model.training_sample(known)).drop("p90")
        fits.saved_fits(fits.fit_by_symbol(model.training_sample(flagged)), path, ended)
    made = fits.score_as_of(I.features(rows), fits.fits_of(spark, path))
    return rounded(made, "predicted_proba_spike").select("symbol", "open_time_ms", "ended_ms", "predicted_proba_spike")


def _marked(spark, sf_dir) -> tuple[str, DataFrame]:
    """A table that a stream of three parts has filled, and the marks that it kept."""
    table, folder = new_table(spark), shared_dir(spark, "marks")
    rows = by_time(events(spark, sf_dir), S.ntz_minute_ms(F.col("ts")), 3)
    streams.start_ingest(C.from_events(_stream(spark, rows, 3)), table, shared_dir(spark, "log"), ["arrival"], marks=folder).awaitTermination()
    return table, marks.kept_marks(spark, folder)


@query(f"WITH {OFFERS_SQL} SELECT symbol, max(open_time_ms) AS high_water_ms, count(*) AS n_rows FROM candles GROUP BY symbol")
def q38_kept_marks(spark, sf_dir):
    return _marked(spark, sf_dir)[1]


@query(ORACLE_SQL["q01_latest_n"])
def q39_newest_stored(spark, sf_dir):
    """q01 over a stored table, read from its newest month back."""
    table, found = _marked(spark, sf_dir)
    return marks.newest_stored(spark, table, found, 5).select("symbol", "open_time_ms", "open_time", "close", "place")


@query(ORACLE_SQL["q10_ratio_p90"])
def q40_kept_quantile(spark, sf_dir):
    """q10 after three appends, from ratios and sketches that each of them kept up."""
    table, rated, sketches = new_table(spark), new_table(spark, ratios.RATIOS), new_table(spark, kept_quantiles.SKETCHES)
    rows = by_time(events(spark, sf_dir), S.ntz_minute_ms(F.col("ts")), 3)
    ratios.start_ratios(C.from_events(_stream(spark, rows, 3)), table, rated, sketches, shared_dir(spark, "log"), ["arrival"]).awaitTermination()
    return rounded(kept_quantiles.kept_quantile(spark.table(rated), spark.table(sketches), "ratio", 0.9, "p90"), "p90")
