"""Column functions for candles. None of them depends on the session's time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: 2017-01-01 00:00 UTC, where the history of an empty table starts.
HISTORY_START_MS = 1_483_228_800_000
LOCAL_OFFSET_MS = 2 * 3_600_000


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def lenient_double(text: Column) -> Column:
    """A number, or null where the text is none. Type suffixes that only the JVM knows are no numbers."""
    trimmed = F.trim(text.cast("string"))
    return F.when(~trimmed.rlike(r"(?i)[0-9.][df]$"), nan_to_null(trimmed.try_cast("double")))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives infinity with a's sign, and null if a is zero too."""
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def rounded(c: Column, places: int = 6) -> Column:
    """c to so many places as SQL engines round doubles: c times a power of ten, to the nearest whole number, halves away from zero, and back. F.round
    takes the shortest decimal text for the number instead, which differs where c lies beside a half."""
    scale = 10.0**places
    size = F.abs(c) * scale
    whole = F.floor(size).cast("double")
    # From 2**52 on, doubles are whole.
    near = F.when(size < 2.0**52, whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(size) / scale
    return F.when(size == float("inf"), c).otherwise(F.when(c < 0, -near).otherwise(near))


def floor_minute(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(MINUTE_MS))


def ntz_minute_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zoneless timestamp, taken as UTC and floored to the minute."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * MINUTE_MS


def ms_to_ntz(ms: Column) -> Column:
    seconds = (ms / F.lit(1000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )


def local_minute_text(ms: Column, offset_ms: int = LOCAL_OFFSET_MS) -> Column:
    """yyyy-MM-dd HH:mm of the minute at a fixed offset."""
    return F.substring(ms_to_ntz(floor_minute(ms + offset_ms)).cast("string"), 1, 16)


def local_month(ms: int, offset_ms: int = LOCAL_OFFSET_MS) -> str:
    """yyyy-MM of one time, on the driver."""
    return f"{datetime.fromtimestamp((ms + offset_ms) / 1000, timezone.utc):%Y-%m}"


def local_text_to_ntz(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm"))


def sync_start(high_water_ms: Column) -> Column:
    return F.coalesce(high_water_ms + MINUTE_MS, F.lit(HISTORY_START_MS))
