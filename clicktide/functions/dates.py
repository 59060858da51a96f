"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktide.functions.numbers import div

# Fixed formats.  The single H also reads hours without a leading zero.
TIME_IN = "yyyy-MM-dd H:mm:ss"
TIME_OUT = "yyyy-MM-dd HH:mm:ss"
DATE_OUT = "yyyy-MM-dd"
DATE_KEY = "yyyyMMdd"
MINUTE_KEY = "yyyyMMddHHmm"


def parse_time(s: Column) -> Column:
    """Timestamp from text; NULL when the text is not a time."""
    return F.try_to_timestamp(s, F.lit(TIME_IN))


def format_time(ts: Column) -> Column:
    return F.date_format(ts, TIME_OUT)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, DATE_OUT)


def date_hour(ts: Column) -> Column:
    """``yyyy-MM-dd_HH``."""
    return F.date_format(ts, "yyyy-MM-dd_HH")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, DATE_KEY)


def parse_date_key(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit(DATE_KEY)).cast("date")


def time_minute(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_KEY)


def millis_to_time(ms: Column) -> Column:
    """Timestamp from epoch milliseconds, cut to whole seconds."""
    return F.date_trunc("second", F.timestamp_millis(ms.cast("bigint")))


def is_before(a: Column, b: Column) -> Column:
    return a < b


def is_after(a: Column, b: Column) -> Column:
    return a > b


def minus_seconds(a: Column, b: Column) -> Column:
    """Whole seconds from ``b`` to ``a``."""
    return F.unix_timestamp(a) - F.unix_timestamp(b)


def visit_millis(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``."""
    return div(F.unix_micros(end) - F.unix_micros(start), 1000)


def today() -> Column:
    return F.current_date()


def yesterday() -> Column:
    return F.date_sub(F.current_date(), 1)
