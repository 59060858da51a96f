"""Click, order and pay counts per category, and the most active sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _exploded(rows: DataFrame, list_col: str) -> DataFrame:
    """One row per number in a comma list, as ``category_id``; other tokens are dropped."""
    tokens = rows.where(F.col(list_col).isNotNull()).withColumn(
        "token", F.explode(F.split(list_col, ","))
    )
    ids = tokens.withColumn("category_id", F.trim("token").try_cast("bigint"))
    return ids.where(F.col("category_id").isNotNull()).drop("token", list_col)


def listed_category_counts(actions: DataFrame, list_col: str, count_name: str) -> DataFrame:
    """How often each category occurs in a comma-list column."""
    ids = _exploded(actions.select(list_col), list_col)
    return ids.groupBy("category_id").agg(F.count(F.lit(1)).alias(count_name))


def category_order_counts(actions: DataFrame) -> DataFrame:
    return listed_category_counts(actions, "order_category_ids", "order_count")


def category_pay_counts(actions: DataFrame) -> DataFrame:
    return listed_category_counts(actions, "pay_category_ids", "pay_count")


def _mentions(actions: DataFrame) -> DataFrame:
    """One row per category mention: session, category and kind."""
    kinds = actions.select(
        "session_id",
        F.stack(
            F.lit(3),
            F.col("click_category_id").cast("string"), F.lit("click"),
            F.col("order_category_ids"), F.lit("order"),
            F.col("pay_category_ids"), F.lit("pay"),
        ).alias("ids", "kind"),
    )
    return _exploded(kinds, "ids")


COUNTS = (("click_count", "click"), ("order_count", "order"), ("pay_count", "pay"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("kind") == F.lit(kind)).alias(name) for name, kind in COUNTS]


def category_counts(actions: DataFrame) -> DataFrame:
    """Clicks, orders and pays per category in one pass.

    Each action is unfolded to (category, kind) rows and counted, so there is one
    scan, one partially aggregated shuffle and no join.
    """
    return _mentions(actions).groupBy("category_id").agg(*_counts())


def session_category_counts(actions: DataFrame) -> DataFrame:
    """The same counts per session and category.

    Restricting these to some sessions, instead of the actions, sends a session
    through the join with one row per category, however many actions it has.
    """
    return _mentions(actions).groupBy("session_id", "category_id").agg(*_counts())


def sum_sessions(pairs: DataFrame) -> DataFrame:
    """Counts per category from counts per session and category."""
    return pairs.groupBy("category_id").agg(
        *[F.sum(name).alias(name) for name, _ in COUNTS]
    )


def top_categories(counts: DataFrame, n: int = 10, include_unclicked: bool = False) -> DataFrame:
    """The ``n`` categories with most clicks, then orders, then pays, then smallest id.

    Categories that were never clicked take part only on request.
    """
    if not include_unclicked:
        counts = counts.where(F.col("click_count") > 0)
    return counts.orderBy(
        F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")
    ).limit(n)


def top_category_sessions(pairs: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sessions with most clicks in each of the given categories.

    ``categories`` is usually a top-k report, whose known size makes Spark
    broadcast it.  The rank filter cuts every partition to ``n`` rows per
    category before the rows meet.
    """
    clicks = pairs.where(F.col("click_count") > 0).select("category_id", "session_id", "click_count")
    wanted = clicks.join(categories.select("category_id"), "category_id", "left_semi")
    best = Window.partitionBy("category_id").orderBy(F.desc("click_count"), F.asc("session_id"))
    ranked = wanted.withColumn("rn", F.row_number().over(best))
    return ranked.where(F.col("rn") <= n).drop("rn")
