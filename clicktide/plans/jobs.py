"""The jobs: parameters from a task record, input tables in, result tables out."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide import functions as fn
from clicktide.operators import ads, area, categories, pageflow, sampling, sessions
from clicktide.session import scratch_dir
from clicktide.sources import readers, tables
from clicktide.sources.tasks import TaskParams, find_task
from clicktide.streaming import ad_stream


SESSION_TABLES = (
    "session_aggr_stat", "session_random_extract", "session_detail", "top10_category",
    "top10_category_session", "area_top3_product",
)


def _task(spark: SparkSession, tables_dir: str, task_id: int) -> TaskParams:
    return find_task(readers.read_table(spark, tables_dir, "task"), task_id)


def _actions(spark: SparkSession, tables_dir: str, task: TaskParams) -> DataFrame:
    actions = readers.read_table(spark, tables_dir, "user_visit_action")
    return readers.action_date_range(actions, task.start_date, task.end_date)


def _stored(df: DataFrame) -> DataFrame:
    """Times and lists as the text the result tables hold."""
    as_text = {
        "start_time": lambda c: fn.format_time(F.col(c)),
        "action_time": lambda c: fn.format_time(F.col(c)),
        "search_keywords": lambda c: F.array_join(c, ","),
        "click_category_ids": lambda c: F.array_join(F.col(c).cast("array<string>"), ","),
    }
    return df.withColumns({c: f(c) for c, f in as_text.items() if c in df.columns})


def run_session_job(
    spark: SparkSession,
    tables_dir: str,
    results_dir: str,
    task_id: int,
    sample_total: int = 100,
    seed: str = "0",
) -> None:
    """Session statistics, sample, top categories and sessions, top products per area."""
    task = _task(spark, tables_dir, task_id)
    store_session_results(
        _actions(spark, tables_dir, task),
        readers.read_table(spark, tables_dir, "user_info"),
        readers.read_table(spark, tables_dir, "city_info"),
        readers.read_table(spark, tables_dir, "product_info"),
        sessions.SessionFilter.from_task(task), results_dir, task_id, sample_total, seed,
    )


def store_session_results(
    actions: DataFrame,
    users: DataFrame,
    cities: DataFrame,
    products: DataFrame,
    params: sessions.SessionFilter,
    results_dir: str,
    task_id: int,
    sample_total: int = 100,
    seed: str = "0",
    only: Collection[str] = SESSION_TABLES,
) -> None:
    """Append the result tables of a session task, or those named in ``only``.

    The log is read for the sessions, the categories, the sample and the areas;
    what several tables need is stored in between.
    """
    spark = actions.sparkSession
    scratch = scratch_dir(spark, "session-job")
    try:
        enriched = sessions.join_users(sessions.aggregate_sessions(actions, params), users)
        chosen = sessions.filter_sessions(enriched, params)
        # without the keyword and category lists, which only the sample needs
        filtered = tables.materialize(
            chosen.select("session_id", "visit_length_ms", "step_length", "start_time"),
            "filtered-sessions", scratch,
        )

        def store(df: DataFrame, table: str) -> None:
            if table in only:
                tables.append_result(_stored(df), results_dir, table, task_id)

        store(sessions.session_aggr_stat(sessions.session_histogram(filtered)), "session_aggr_stat")
        if {"session_random_extract", "session_detail"} & set(only):
            ids = tables.materialize(sampling.sample_ids(filtered, sample_total, seed), "sample-ids", scratch)
            drawn = tables.materialize(sessions.of_sessions(actions, ids), "sample-actions", scratch)
            records = sessions.aggregate_sessions(drawn)
            store(
                sampling.session_sample(filtered, sample_total, records=records, ids=ids),
                "session_random_extract",
            )
            store(drawn.select(*sampling.DETAIL_COLUMNS), "session_detail")
        if {"top10_category", "top10_category_session"} & set(only):
            counts = categories.session_category_counts(actions)
            pairs = tables.materialize(sessions.of_sessions(counts, filtered), "session-categories", scratch)
            top = tables.materialize(
                categories.top_categories(categories.sum_sessions(pairs)), "top-categories", scratch
            )
            store(top, "top10_category")
            store(categories.top_category_sessions(pairs, top), "top10_category_session")
        if "area_top3_product" in only:
            clicks = area.product_clicks(actions)
            store(area.area_top_products(clicks, cities, products), "area_top3_product")
    finally:
        tables.remove_folder(spark, scratch)


def run_page_flow_job(spark: SparkSession, tables_dir: str, results_dir: str, task_id: int) -> None:
    """Conversion rates of the task's page flow."""
    task = _task(spark, tables_dir, task_id)
    if not task.target_page_flow:
        raise ValueError(f"task {task_id} has no target page flow")
    rates = pageflow.page_convert_rate(_actions(spark, tables_dir, task), task.target_page_flow)
    tables.append_result(
        pageflow.convert_rate_text(rates), results_dir, "page_split_convert_rate", task_id
    )


def run_ad_stream_job(
    spark: SparkSession,
    lines: DataFrame,
    tables_dir: str,
    threshold: int = ads.CLICK_LIMIT,
    keep: str | None = None,
    interval: str = ad_stream.INTERVAL,
) -> None:
    """Run the ad pipeline over a stream of text lines until it is stopped."""
    clicks = ads.parse_ad_lines(lines, F.current_timestamp())
    ad_stream.start_all(
        spark, clicks, ad_stream.AdTables(tables_dir), threshold, keep, interval, lines
    )
    spark.streams.awaitAnyTermination()
