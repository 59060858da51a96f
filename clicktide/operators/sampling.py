"""Proportional session samples.

A sample takes the sessions with the smallest ``md5(seed-session_id)`` of each
group, so it is random with respect to the data and repeatable.  Of a group's n draws
the smallest ``quota`` lie below about ``quota / n`` of their range: a row above that
share, with some slack, is dropped where it is read.  What is left is ranked, and a
group that is left with too few is ranked from all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.functions import div, ratio, rounded_share
from clicktide.operators.sessions import of_sessions
from clicktide.sources.tables import materialize

DETAIL_COLUMNS = (
    "user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id",
    "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids",
    "pay_product_ids",
)


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    """Sessions per date and hour of their start."""
    return sessions.groupBy(
        F.to_date("start_time").alias("date"), F.hour("start_time").alias("hour")
    ).agg(F.count(F.lit(1)).alias("session_count"))


def hour_share(sessions: DataFrame, total: int = 100) -> DataFrame:
    """Sessions per hour of day, share of all sessions in percent, and sample quota."""
    counts = sessions.groupBy(F.hour("start_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("session_count")
    )
    everything = counts.agg(F.sum("session_count")).scalar()
    n = F.col("session_count")
    return counts.select(
        "hour",
        "session_count",
        ratio(n * 100, everything).alias("share"),
        F.least(rounded_share(n, everything, total), n).alias("quota"),
    )


def sample_quota(sessions: DataFrame, total: int = 100) -> DataFrame:
    """Sessions to draw per date and hour.

    Every date gets ``total`` divided by the number of dates, cut to a whole
    number; an hour gets its share of that, cut again, and never more than it has.
    """
    hours = sessions_per_hour(sessions)
    days = hours.agg(F.count_distinct("date")).scalar()
    in_day = Window.partitionBy("date")
    n = F.col("session_count")
    with_day = hours.select(
        "date", "hour", "session_count",
        F.sum("session_count").over(in_day).alias("day_count"),
        div(F.lit(total), days).alias("day_quota"),
    )
    # double arithmetic in this order, then truncation
    share = n.cast("double") / F.col("day_count").cast("double") * F.col("day_quota").cast("double")
    return with_day.select(
        "date", "hour", "session_count", F.least(F.floor(share), n).alias("quota")
    )


def expected_below(quota: Column) -> Column:
    """How many of a group's rows the cut lets through on average: six deviations more than the quota."""
    return quota + 6 * F.sqrt(quota) + 16


def _smallest_per_group(rows: DataFrame, quotas: DataFrame, group: list[str], seed: str) -> DataFrame:
    """Ids of the ``quota`` rows of each group with the smallest draw.

    ``quotas`` has a row per group with ``quota`` and ``session_count``, ``rows`` the
    sessions with their group.
    """
    wanted = quotas.where(F.col("quota") > 0).select(*group, "quota", "session_count")
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col("session_id")))
    # at most 24 quota rows per calendar day
    keyed = rows.join(F.broadcast(wanted), group).withColumn("draw", draw)
    # the draw's first 48 bits in [0, 1), in the order of the draws
    share = F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(1 << 48)
    columns = [*group, "session_id", "draw", "quota"]
    below = keyed.where(share * F.col("session_count") <= expected_below(F.col("quota"))).select(*columns)
    # one row of each group besides, so that a group without any is found too
    nobody = wanted.select(*group, F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("draw"), "quota")
    near = materialize(below.unionByName(nobody), "sample-near")
    short = near.groupBy(*group).agg(F.count("session_id").alias("have"), F.max("quota").alias("quota"))
    short = short.where(F.col("have") < F.col("quota")).select(*group)
    if not short.isEmpty():
        again = keyed.select(*columns).join(F.broadcast(short), group, "left_semi")
        near = near.join(F.broadcast(short), group, "left_anti").unionByName(again)
    smallest = Window.partitionBy(*group).orderBy("draw", "session_id")
    ranked = near.where("session_id is not null").withColumn("rn", F.row_number().over(smallest))
    return ranked.where(F.col("rn") <= F.col("quota")).select("session_id")


def _record_columns(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "start_time", "search_keywords", "click_category_ids")


def sample_ids(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """Ids of about ``total`` sessions, drawn per date and hour in proportion."""
    slim = sessions.select("session_id", "start_time")
    timed = slim.select(
        "session_id", F.to_date("start_time").alias("date"), F.hour("start_time").alias("hour")
    )
    return _smallest_per_group(timed, sample_quota(slim, total), ["date", "hour"], seed)


def sample_ids_by_hour(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """Ids of about ``total`` sessions, drawn per hour of day in proportion."""
    slim = sessions.select("session_id", "start_time")
    timed = slim.select("session_id", F.hour("start_time").alias("hour"))
    return _smallest_per_group(timed, hour_share(slim, total), ["hour"], seed)


# A sample of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def _hint(ids: DataFrame, total: int) -> DataFrame:
    # ids holds at most `total` rows (at most total + 24 when shares round up)
    return F.broadcast(ids) if total <= BROADCAST_ROWS else ids


def session_sample(
    sessions: DataFrame,
    total: int = 100,
    seed: str = "0",
    records: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """The sampled session records.

    ``records`` are the sessions with their lists, if ``sessions`` has none.  Given
    as an aggregate of the log, only the sampled sessions are aggregated.  ``ids``
    is the sample, if it has been drawn before.
    """
    ids = _hint(sample_ids(sessions, total, seed) if ids is None else ids, total)
    full = sessions if records is None else records
    return _record_columns(full).join(ids, "session_id", "left_semi")


def session_sample_by_hour(
    sessions: DataFrame, total: int = 100, seed: str = "0"
) -> DataFrame:
    """The session records sampled by hour of day, with that hour."""
    ids = _hint(sample_ids_by_hour(sessions, total, seed), total)
    picked = _record_columns(sessions).join(ids, "session_id", "left_semi")
    return picked.withColumn("hour", F.hour("start_time"))


def session_sample_detail(
    actions: DataFrame,
    sessions: DataFrame,
    total: int = 100,
    seed: str = "0",
) -> DataFrame:
    """All actions of the sampled sessions."""
    ids = _hint(sample_ids(sessions, total, seed), total)
    return of_sessions(actions, ids).select(*DETAIL_COLUMNS)
