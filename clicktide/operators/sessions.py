"""Session aggregation, enrichment, filters, histograms and the text record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.functions import (
    format_time,
    get_field,
    parse_time,
    percent_text,
    ratio,
    visit_millis,
)
from clicktide.sources.tasks import TaskParams

# --- aggregation and enrichment -------------------------------------------


def aggregate_sessions(actions: DataFrame, params: SessionFilter | None = None) -> DataFrame:
    """One row per session.

    Everything is a partially aggregated ``groupBy``, so a session that holds a
    large part of the log is reduced before the shuffle.  A query that needs no
    keyword or category list drops those columns and stays a plain hash
    aggregate.  With ``params``, whether a session meets the keyword and category
    parameters is aggregated too, and the filter need not see the lists either.
    """
    hits = [] if params is None else [
        F.bool_or(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in params.hits().items()
    ]
    grouped = actions.groupBy("session_id").agg(
        F.max("user_id").alias("user_id"),
        F.sort_array(F.collect_set(F.nullif("search_keyword", F.lit("")))).alias("search_keywords"),
        F.sort_array(F.collect_set("click_category_id")).alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        F.max("action_time").alias("end_time"),
        F.count(F.lit(1)).alias("step_length"),
        *hits,
    )
    return grouped.select(
        "session_id",
        "user_id",
        "search_keywords",
        "click_category_ids",
        visit_millis(F.col("start_time"), F.col("end_time")).alias("visit_length_ms"),
        "step_length",
        "start_time",
        *([] if params is None else params.hits()),
    )


def join_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with the attributes of their user; sessions of unknown users go.

    The join side is left to Spark: a user table below the broadcast limit is
    broadcast, a larger one is shuffled with skewed users split at run time.
    """
    profile = users.select("user_id", "age", "professional", "city", "sex")
    return sessions.join(profile, "user_id", "inner")


# --- filters --------------------------------------------------------------


def between_if(col: str, low, high) -> Column:
    """Inclusive range; no restriction unless both bounds are given."""
    if low is None or high is None:
        return F.lit(True)
    return F.col(col).between(low, high)


def any_of_if(col: str, values: Sequence | None) -> Column:
    """Scalar membership; no restriction without values."""
    return F.lit(True) if values is None else F.col(col).isin(list(values))


def overlaps_if(col: str, values: Sequence | None) -> Column:
    """Array column shares an element with ``values``; no restriction without values."""
    if values is None:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(col, F.array(*[F.lit(v) for v in values])), F.lit(False))


def equal_if(col: str, value) -> Column:
    """Equality; no restriction without a value."""
    return F.lit(True) if value is None else F.col(col) == F.lit(value)


@dataclass(frozen=True)
class SessionFilter:
    """The optional filter parameters, all of which must hold."""

    start_age: int | None = None
    end_age: int | None = None
    professionals: Sequence[str] | None = None
    cities: Sequence[str] | None = None
    sex: Sequence[str] | None = None
    keywords: Sequence[str] | None = None
    category_ids: Sequence[int] | None = None

    @classmethod
    def from_task(cls, task: TaskParams) -> SessionFilter:
        return cls(
            task.start_age, task.end_age, task.professionals, task.cities, task.sex,
            task.keywords, task.category_ids,
        )

    def hits(self) -> dict[str, Column]:
        """What one action must show, for the parameters that look into a session."""
        return {
            "keyword_hit": any_of_if("search_keyword", self.keywords),
            "category_hit": any_of_if("click_category_id", self.category_ids),
        }

    def user_predicate(self) -> Column:
        return (
            between_if("age", self.start_age, self.end_age)
            & any_of_if("professional", self.professionals)
            & any_of_if("city", self.cities)
            & any_of_if("sex", self.sex)
        )

    def list_predicate(self) -> Column:
        ids = self.category_ids
        id_array = None if ids is None else [F.lit(int(c)).cast("bigint") for c in ids]
        return overlaps_if("search_keywords", self.keywords) & overlaps_if(
            "click_category_ids", id_array
        )


def filter_sessions(sessions: DataFrame, params: SessionFilter) -> DataFrame:
    """Sessions that meet every parameter given."""
    hits = list(params.hits())
    if set(hits) <= set(sessions.columns):
        inside = F.col(hits[0]) & F.col(hits[1])
    else:
        inside = params.list_predicate()
    return sessions.where(params.user_predicate() & inside).drop(*hits)


def _condition(text: str) -> Column:
    key, _, value = text.partition(":")
    if key == "age":
        low, _, high = value.partition("-")
        return F.col("age").between(int(low), int(high))
    if key in ("sex", "city", "professional"):
        return equal_if(key, value)
    raise ValueError(f"unknown condition: {text!r}")


def filter_conditions(sessions: DataFrame, *conditions: str) -> DataFrame:
    """Filter by texts such as ``age:7-13`` and ``sex:male``, all of which must hold."""
    return sessions.where(reduce(lambda a, b: a & b, map(_condition, conditions), F.lit(True)))


def of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The rows (actions, or anything else with a session id) of the given sessions."""
    return rows.join(sessions.select("session_id"), "session_id", "left_semi")


# --- histogram ------------------------------------------------------------

# Fixed buckets: label, exclusive lower edge, inclusive upper edge (None: open).
VISIT_SECONDS = (
    ("1s_3s", 0, 3),
    ("4s_6s", 3, 6),
    ("7s_9s", 6, 9),
    ("10s_30s", 9, 30),
    ("30s_60s", 30, 60),
    ("1m_3m", 60, 180),
    ("3m_10m", 180, 600),
    ("10m_30m", 600, 1800),
    ("30m", 1800, None),
)
STEP_COUNTS = (
    ("1_3", 0, 3),
    ("4_6", 3, 6),
    ("7_9", 6, 9),
    ("10_30", 9, 30),
    ("30_60", 30, 60),
    ("60", 60, None),
)


def _bucket_counts(value: Column, prefix: str, buckets: Sequence[tuple]) -> list[Column]:
    def inside(low, high):
        above = value > low
        return above if high is None else above & (value <= high)

    return [F.count_if(inside(lo, hi)).alias(f"{prefix}_{label}") for label, lo, hi in buckets]


def session_histogram(
    sessions: DataFrame,
    visit_buckets: Sequence[tuple] = VISIT_SECONDS,
    step_buckets: Sequence[tuple] = STEP_COUNTS,
) -> DataFrame:
    """One row: session count and a count per length bucket.

    Milliseconds are cut to whole seconds first; zero-length visits fall in no bucket.
    """
    # lengths are never negative, so dropping the millisecond digits truncates
    seconds = F.call_function("div", F.col("visit_length_ms"), F.lit(1000))
    return sessions.agg(
        F.count(F.lit(1)).alias("session_count"),
        *_bucket_counts(seconds, "visit_length", visit_buckets),
        *_bucket_counts(F.col("step_length"), "step_length", step_buckets),
    )


def _bucket_columns(histogram: DataFrame) -> list[str]:
    return [c for c in histogram.columns if c != "session_count"]


def session_aggr_stat(histogram: DataFrame) -> DataFrame:
    """Each bucket as a share of all sessions, two decimals."""
    total = F.col("session_count")
    return histogram.select(
        "session_count",
        *[ratio(F.col(c), total).alias(f"{c}_ratio") for c in _bucket_columns(histogram)],
    )


def histogram_percent(histogram: DataFrame) -> DataFrame:
    """Each bucket as percentage text such as ``12.34%``."""
    total = F.col("session_count")
    return histogram.select(
        "session_count",
        *[percent_text(F.col(c), total).alias(c) for c in _bucket_columns(histogram)],
    )


# --- text record ----------------------------------------------------------

# Fixed format: session id, \x01, then k=v fields each ended by |.
SEPARATOR = "\u0001"
RECORD_FIELDS = (
    ("sessionid", "session_id"),
    ("searchKeywords", "search_keywords"),
    ("clickCategoryIds", "click_category_ids"),
    ("visitLength", "visit_length_ms"),
    ("stepLength", "step_length"),
    ("startTime", "start_time"),
    ("age", "age"),
    ("professional", "professional"),
    ("city", "city"),
    ("sex", "sex"),
)


def encode_sessions(sessions: DataFrame) -> DataFrame:
    """Enriched sessions as text lines in column ``value``."""

    def text(col: str) -> Column:
        if col == "start_time":
            return format_time(F.col(col))
        if col in ("search_keywords", "click_category_ids"):
            return F.array_join(F.col(col).cast("array<string>"), ",")
        return F.col(col).cast("string")

    fields = [
        F.concat(F.lit(f"{name}="), F.coalesce(text(col), F.lit("")), F.lit("|"))
        for name, col in RECORD_FIELDS
    ]
    return sessions.select(
        F.concat(F.col("session_id"), F.lit(SEPARATOR), *fields).alias("value")
    )


def decode_sessions(lines: DataFrame) -> DataFrame:
    """Text lines back to typed columns; empty fields become NULL or empty lists."""
    part = F.split("value", SEPARATOR, 2)
    record = lines.select(
        F.get(part, F.lit(0)).alias("session_id"), F.get(part, F.lit(1)).alias("info")
    )

    def field(name: str) -> Column:
        return get_field(F.col("info"), name)

    def listed(name: str) -> Column:
        return F.coalesce(F.split(field(name), ","), F.array().cast("array<string>"))

    return record.select(
        "session_id",
        listed("searchKeywords").alias("search_keywords"),
        listed("clickCategoryIds").cast("array<bigint>").alias("click_category_ids"),
        field("visitLength").try_cast("bigint").alias("visit_length_ms"),
        field("stepLength").try_cast("bigint").alias("step_length"),
        parse_time(field("startTime")).alias("start_time"),
        field("age").try_cast("int").alias("age"),
        field("professional").alias("professional"),
        field("city").alias("city"),
        field("sex").alias("sex"),
    )
