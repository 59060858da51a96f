"""Ad-click operators.  Apart from the top-n, each also runs on a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.functions import millis_to_time

CLICK_COLUMNS = ("event_time", "date", "province", "city", "user_id", "ad_id")

# --- text lines -----------------------------------------------------------


# Milliseconds from the year 1970 to the end of 9999: what a date folder can name.
MILLIS_RANGE = (0, 253_402_300_799_999)
# Clock error that a click may have ahead of its arrival.
AHEAD_SECONDS = 86_400


def _parsed(lines: DataFrame, arrival: Column | None) -> DataFrame:
    # "<epoch ms> <province> <city> <user id> <ad id>", perhaps with blanks behind
    part = F.split(F.rtrim("value"), " ")
    millis = F.get(part, F.lit(0)).try_cast("bigint")
    # compared before it becomes a time, as the conversion fails on large numbers
    millis = F.when(millis.between(*MILLIS_RANGE), millis)
    if arrival is not None:
        latest = F.unix_millis(arrival) + F.lit(1000 * AHEAD_SECONDS)
        millis = F.when(millis <= latest, millis)
    typed = lines.select(
        "value",
        F.size(part).alias("fields"),
        millis_to_time(millis).alias("event_time"),
        F.get(part, F.lit(1)).alias("province"),
        F.get(part, F.lit(2)).alias("city"),
        F.get(part, F.lit(3)).try_cast("bigint").alias("user_id"),
        F.get(part, F.lit(4)).try_cast("bigint").alias("ad_id"),
    )
    return typed.withColumn("date", F.to_date("event_time"))


def _well_formed() -> Column:
    typed = [F.col(c).isNotNull() for c in ("event_time", "user_id", "ad_id")]
    return (F.col("fields") == 5) & typed[0] & typed[1] & typed[2]


def parse_ad_lines(lines: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Typed clicks from text lines in column ``value``; the lines that :func:`rejected_ad_lines` gives are left out."""
    return _parsed(lines, arrival).where(_well_formed()).select(*CLICK_COLUMNS)


def rejected_ad_lines(lines: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Lines without five fields, or with a time, user or ad that is no number in its range.

    With ``arrival`` also those dated more than ``AHEAD_SECONDS`` after it: one
    clock far ahead would otherwise move every watermark past the other clicks.
    """
    return _parsed(lines, arrival).where(~_well_formed() | F.col("value").isNull()).select("value")


# --- blacklist ------------------------------------------------------------

CLICK_LIMIT = 100


def user_daily_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, user, ad)."""
    return clicks.groupBy("date", "user_id", "ad_id").agg(F.count(F.lit(1)).alias("click_count"))


def over_limit_users(daily: DataFrame, threshold: int = CLICK_LIMIT) -> DataFrame:
    """Distinct users with more than ``threshold`` clicks on one ad on one day."""
    return daily.where(F.col("click_count") > threshold).select("user_id").distinct()


def blacklist(clicks: DataFrame, threshold: int = CLICK_LIMIT) -> DataFrame:
    return over_limit_users(user_daily_clicks(clicks), threshold)


def drop_listed(clicks: DataFrame, listed: DataFrame) -> DataFrame:
    """Clicks of users that are not on the list.

    Without a broadcastable list this is a shuffled anti-join whose hot users
    are split at run time.
    """
    return clicks.join(listed.select("user_id"), "user_id", "left_anti").select(*clicks.columns)


# --- counts ---------------------------------------------------------------


def ad_stat(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, province, city, ad)."""
    return clicks.groupBy("date", "province", "city", "ad_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )


def province_counts(stat: DataFrame) -> DataFrame:
    """City counts summed to (date, province, ad)."""
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def top_per_province(counts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` rows with the highest count of each (date, province)."""
    best = Window.partitionBy("date", "province").orderBy(F.desc("click_count"), F.asc("ad_id"))
    ranked = counts.withColumn("rn", F.row_number().over(best))
    return ranked.where(F.col("rn") <= n).drop("rn")


def province_top(stat: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most clicked ads of each (date, province), from city-level counts."""
    return top_per_province(province_counts(stat), n)


def click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, hour, minute, ad)."""
    return clicks.groupBy(
        "date",
        F.hour("event_time").alias("hour"),
        F.minute("event_time").alias("minute"),
        "ad_id",
    ).agg(F.count(F.lit(1)).alias("click_count"))


def minute_range(newest: datetime, minutes: int = 60) -> tuple[datetime, datetime]:
    """Begin and end of the ``minutes`` minutes that end with the minute of ``newest``."""
    end = newest.replace(second=0, microsecond=0) + timedelta(minutes=1)
    return end - timedelta(minutes=minutes), end


def last_minutes(clicks: DataFrame, minutes: int = 60, as_of: datetime | None = None) -> DataFrame:
    """Clicks of the last ``minutes`` minutes up to the minute of ``as_of`` (default: the newest click).

    Plain ranges on ``date`` and ``event_time``, which reach partitions and row groups.
    """
    newest = clicks.agg(F.max("event_time")).first()[0] if as_of is None else as_of
    if newest is None:
        return clicks.where(F.lit(False))
    start, end = minute_range(newest, minutes)
    inside = (F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end))
    return clicks.where(inside & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def recent_trend(trend: DataFrame, minutes: int = 60, as_of: Column | None = None) -> DataFrame:
    """The minutes of a stored trend in the last hour before ``as_of`` (default: its newest minute)."""
    at = F.make_timestamp(
        F.year("date"), F.month("date"), F.day("date"), F.col("hour"), F.col("minute"), F.lit(0)
    )
    if as_of is None:
        as_of = trend.agg(F.max(at)).scalar()
    start = F.timestamp_seconds(F.unix_seconds(as_of) - F.lit(60 * minutes))
    return trend.where((at > start) & (at <= as_of))


# --- the sliding hour -----------------------------------------------------

PANE_SECONDS = 5
HOUR_SECONDS = 3600


def _inside(pane: Column, newest: Column, hour: int, step: int) -> Column:
    """Panes of the window that ends with the one of ``newest``."""
    last = F.floor(F.unix_seconds(newest) / step)
    return (pane <= last) & (pane > last - hour // step)


def hour_panes(
    clicks: DataFrame, newest: Column, hour: int = HOUR_SECONDS, step: int = PANE_SECONDS
) -> DataFrame:
    """Clicks per pane of ``step`` seconds and ad, in the ``hour`` seconds that end with the pane of ``newest``.

    The window slides by a pane; partial counts of panes are added by :func:`combined_panes`.
    """
    pane = F.floor(F.unix_seconds("event_time") / step).cast("bigint")
    return (
        clicks.select(pane.alias("pane"), "ad_id").where(_inside(F.col("pane"), newest, hour, step))
        .groupBy("pane", "ad_id").agg(F.count(F.lit(1)).alias("click_count"))
    )


def combined_panes(
    panes: DataFrame, newest: Column, hour: int = HOUR_SECONDS, step: int = PANE_SECONDS
) -> DataFrame:
    """Partial counts added up, without the panes that have left the window."""
    alive = panes.where(_inside(F.col("pane"), newest, hour, step))
    return alive.groupBy("pane", "ad_id").agg(F.sum("click_count").alias("click_count"))


def panes_by_minute(panes: DataFrame, step: int = PANE_SECONDS) -> DataFrame:
    """Clicks per (date, hour, minute, ad) of some panes."""
    at = F.timestamp_seconds(F.col("pane") * step)
    return panes.groupBy(
        F.to_date(at).alias("date"), F.hour(at).alias("hour"), F.minute(at).alias("minute"), "ad_id",
    ).agg(F.sum("click_count").alias("click_count"))
