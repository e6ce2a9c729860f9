"""All indicators of a spec as streaming state, for candles that come out of order.

State of a symbol: rows that wait for the watermark, by day; the closes that frames look back on (140 for the default spec), as a list; the
exponential means and the number of rows. When the watermark has passed a minute, an event-time timer releases it: the rows that wait
before the watermark are taken day by day, in order, so a call holds a day of a symbol (1,440 rows) and never its whole batch.

Defined cases: of the rows of a minute the first batch's counts, and within a batch the one of the least arrival; a row whose minute the
watermark has passed is late: it is given back at once, with `late` true and no indicators, and changes nothing; rows without a close are clock
ticks, which only move the watermark on; a zero divisor gives a signed infinity, 0 / 0 null; rows that the watermark hasn't passed
when a stream ends wait in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import MINUTE_MS
from ..operators.indicators import DEFAULT_SPEC, FAST, FRAMES, RUN, SIGNAL, SLOW, Indicator, span

DAY_MS = 86_400_000


def carried(values: np.ndarray, alpha: float, before: float | None) -> np.ndarray:
    """The exponential mean of values that follow a mean."""
    series = pd.Series(values if before is None else np.concatenate([[before], values]))
    return series.ewm(alpha=alpha, adjust=False).mean().to_numpy()[0 if before is None else 1 :]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def frame_means(windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The means of frames that end at these places, added up in the order of indicators.mean_of."""
    k, total = windows.shape[1], np.zeros(len(windows))
    for p in range(RUN):
        rows = windows[place % RUN == p]
        before, since = ((k - 1 - p) % RUN, (p + 1) % RUN) if k >= RUN else (k, 0)
        parts = [rows[:, j] for j in range(before)]
        parts += [sum(rows[:, j] for j in range(g, g + RUN)) for g in range(before, k - since, RUN)]
        parts += [rows[:, j] for j in range(k - since, k)]
        total[place % RUN == p] = sum(parts)
    return total / k


class Series:
    """Indicators of a series that is given in parts. means: what the exponential means were after `n` rows; closes: the last ones."""

    def __init__(self, spec: tuple[Indicator, ...], n: int = 0, means: dict[str, float] | None = None, closes: np.ndarray | None = None):
        self.spec, self.n, self.means = spec, n, dict(means or {})
        self.closes = np.empty(0) if closes is None else closes
        self.back = max([1] + [s.window for s in spec if s.kind in FRAMES])

    def _mean(self, name: str, values: np.ndarray, alpha: float) -> np.ndarray:
        found = carried(values, alpha, self.means.get(name))
        if len(found):
            self.means[name] = float(found[-1])
        return found

    def add(self, c: np.ndarray) -> dict[str, np.ndarray]:
        """The indicators of the next closes."""
        if np.isnan(c).any():
            raise ValueError("a close is missing")
        place, made = self.n + np.arange(len(c)), {}
        known = np.concatenate([self.closes, c])
        first = len(known) - len(c)
        move = np.diff(c, prepend=self.closes[-1] if len(self.closes) else c[0])

        def frames(k: int) -> tuple[np.ndarray, np.ndarray]:
            mean, dev = np.full(len(c), np.nan), np.full(len(c), np.nan)
            full = place >= k - 1
            if full.any():
                windows = np.lib.stride_tricks.sliding_window_view(known, k)[-int(full.sum()) :]
                mean[full], dev[full] = frame_means(windows, place[full]), windows.std(1)
            return mean, dev

        for s in self.spec:
            if s.kind == "roc":
                before = np.full(len(c), np.nan)
                has = place >= s.window
                before[has] = known[first - s.window + np.flatnonzero(has)]
                made[s.column] = _ratio(c - before, before) * 100
            elif s.kind == "sma_ratio":
                made[s.column] = _ratio(c, frames(s.window)[0])
            elif s.kind == "bb_width":
                mean, dev = frames(s.window)
                made[s.column] = _ratio(400 * dev, mean)
            elif s.kind == "rsi":
                ups, downs = (self._mean(f"{n}{s.window}", np.maximum(m, 0), 1 / s.window) for n, m in (("gain", move), ("loss", -move)))
                rsi = np.where(downs == 0, 100.0, 100 - 100 / (1 + _ratio(ups, downs)))
                made[s.column] = np.where(place >= s.window - 1, rsi, np.nan)
            elif s.kind == "macd_diff":
                macd = self._mean("fast", c, span(FAST)) - self._mean("slow", c, span(SLOW))
                diff, late = np.full(len(c), np.nan), place >= SLOW - 1
                if late.any():
                    diff[late] = macd[late] - self._mean("signal", macd[late], span(SIGNAL))
                made[s.column] = np.where(place >= SLOW + SIGNAL - 2, diff, np.nan)
        self.n, self.closes = self.n + len(c), known[-self.back :]
        return made


class FeatureState(StatefulProcessor):
    def __init__(self, spec: tuple[Indicator, ...]):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.means = handle.getValueState("means", "n long, names array<string>, means array<double>")
        self.ring = handle.getListState("closes", "close double")
        self.waiting = handle.getMapState("waiting", "day long", "minutes array<long>, closes array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, least = timerValues.getCurrentWatermarkInMs(), None
        new: dict[int, list[tuple[int, int, float]]] = {}
        for part in rows:
            part = part[part["close"].notna()]
            minutes = part["open_time_ms"] // MINUTE_MS * MINUTE_MS
            late = part[minutes < passed]
            if len(late):
                yield self.told(key, late["open_time_ms"].to_numpy(), late["close"].to_numpy(), None)
            kept = part[minutes >= passed]
            for ms, arrival, close in zip(minutes[minutes >= passed].tolist(), kept["arrival"].tolist(), kept["close"].tolist(), strict=True):
                new.setdefault(ms // DAY_MS, []).append((ms, arrival, close))
            if sum(map(len, new.values())) > 4 * DAY_MS // MINUTE_MS:
                least = self.keep(new, least)
                new = {}
        least = self.keep(new, least)
        if least is not None:
            self.handle.registerTimer(least)

    def keep(self, new: dict[int, list[tuple[int, int, float]]], least: int | None) -> int | None:
        """Lets rows wait, by day; of a minute that waits already nothing is taken. Gives the least minute so far."""
        for day, own in new.items():
            held = self.waiting.getValue((day,)) if self.waiting.containsKey((day,)) else ([], [])
            found = dict(zip(held[0], held[1], strict=True))
            for ms, _, close in sorted(own):
                found.setdefault(ms, close)
            order = sorted(found)
            self.waiting.updateValue((day,), (order, [found[m] for m in order]))
            least = order[0] if least is None else min(least, order[0])
        return least

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        n, names, means = self.means.get() if self.means.exists() else (0, [], [])
        series = Series(self.spec, n, dict(zip(names, means, strict=True)), np.array([r[0] for r in self.ring.get()]) if n else None)
        ahead = None
        for (day,) in sorted(tuple(k) for k in self.waiting.keys()):
            minutes, closes = self.waiting.getValue((day,))
            ready = sum(m < passed for m in minutes)  # they stand in order
            if ready:
                c = np.array(closes[:ready], np.float64)
                yield self.told(key, np.array(minutes[:ready]), c, series.add(c))
            if ready == len(minutes):
                self.waiting.removeKey((day,))
                continue
            self.waiting.updateValue((day,), (list(minutes[ready:]), list(closes[ready:])))
            ahead = minutes[ready]
            break
        if series.n > n:
            self.means.update((series.n, list(series.means), list(series.means.values())))
            self.ring.put([(float(c),) for c in series.closes])
        if ahead is not None:
            self.handle.registerTimer(int(max(ahead, passed + 1)))

    def told(self, key, ms: np.ndarray, closes: np.ndarray, made: dict[str, np.ndarray] | None) -> pd.DataFrame:
        none = lambda x: pd.Series(x, dtype=object).where(~np.isnan(x), None)
        empty = np.full(len(ms), np.nan)
        columns = {s.column: none(empty if made is None else made[s.column]) for s in self.spec}
        return pd.DataFrame({"symbol": key[0], "open_time_ms": ms, "close": closes, "late": made is None, **columns})

    def close(self) -> None:
        pass


def stream_features(candles: DataFrame, delay: str, spec: tuple[Indicator, ...] = DEFAULT_SPEC) -> DataFrame:
    """A stream of (symbol, open_time_ms, close, arrival) with its indicators, and the late rows. delay: how far behind the newest row
    of all a row may come. Needs the RocksDB state store."""
    timed = candles.withColumn("__time", F.timestamp_millis("open_time_ms")).withWatermark("__time", delay)
    rows = timed.select("symbol", "open_time_ms", "close", "arrival")  # without the time, so that Spark leaves late rows to be counted
    kinds = ", ".join(f"{s.column} double" for s in spec)
    return rows.groupBy("symbol").transformWithStateInPandas(
        FeatureState(spec), f"symbol string, open_time_ms long, close double, late boolean, {kinds}", outputMode="append", timeMode="EventTime"
    )
