"""Registered queries: one per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide import functions as fn
from clicktide.operators import ads, area, categories, gaps, pageflow, sampling, sessions
from clicktide.plans import bindings as b
from clicktide.plans import jobs
from clicktide.session import scratch_dir
from clicktide.sources import readers, schemas, tables, tasks
from clicktide.streaming import ad_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries; plans/oracle.py states the same values.
FILTER = sessions.SessionFilter(start_age=20, end_age=60, professionals=("BUILDING", "HOUSEHOLD"))
DATES = ("2024-01-05", "2024-01-20")
FLOW = (2, 3, 4)
SAMPLE = 3000
HOUR_SAMPLE = 100
THRESHOLD = 2
# Within days, so that a day's totals change in two arrivals.
ARRIVALS = ("2024-01-11 12:00:00", "2024-01-20 12:00:00")
KEEP = "2 days"
HOURS = 3600
WIDE_VISITS = (
    ("under_1h", 0, HOURS),
    ("1h_3h", HOURS, 3 * HOURS),
    ("3h_6h", 3 * HOURS, 6 * HOURS),
    ("6h_12h", 6 * HOURS, 12 * HOURS),
    ("12h", 12 * HOURS, None),
)
NARROW_STEPS = (("1", 0, 1), ("2", 1, 2), ("3_4", 2, 4), ("5", 4, None))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _date(col: str = "date") -> Column:
    return fn.format_date(F.col(col)).alias(col)


def _list(col: str) -> Column:
    return F.array_join(F.col(col).cast("array<string>"), ",").alias(col)


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.join_users(
        sessions.aggregate_sessions(b.actions(spark, sf)), b.user_info(spark, sf)
    )


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.filter_sessions(_enriched(spark, sf), FILTER)


def _filtered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = categories.session_category_counts(b.actions(spark, sf))
    return sessions.of_sessions(pairs, _filtered(spark, sf))


def _session_row(df: DataFrame) -> DataFrame:
    shown = {
        "search_keywords": _list("search_keywords"),
        "click_category_ids": _list("click_category_ids"),
        "start_time": fn.format_time(F.col("start_time")).alias("start_time"),
    }
    return df.select(*[shown.get(c, F.col(c)) for c in df.columns])


# --- sessions -------------------------------------------------------------


@query
def action_date_range(spark: SparkSession, sf: str) -> DataFrame:
    """Actions within a date range."""
    rows = readers.action_date_range(b.actions(spark, sf, *DATES, cities=True), *DATES)
    return rows.select(
        _date(), "user_id", "session_id", "page_id",
        fn.format_time(F.col("action_time")).alias("action_time"), "search_keyword",
        "click_category_id", "click_product_id", "order_category_ids", "order_product_ids",
        "pay_category_ids", "pay_product_ids", "city_id",
    )


@query
def session_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(sessions.aggregate_sessions(b.actions(spark, sf)))


@query
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its user's session, cut where six hours pass without an event."""
    log = b.events_by_user(spark, sf)
    return gaps.number_sessions(log, tie="event_id").select("event_id", "user_id", "session_no")


def _gap_actions(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.cut_at_gaps(b.actions(spark, sf))


@query
def gap_session_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(sessions.aggregate_sessions(_gap_actions(spark, sf)))


@query
def gap_page_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pageflow.page_split_counts(_gap_actions(spark, sf), FLOW)


@query
def session_user_join(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(_enriched(spark, sf))


@query
def session_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(_filtered(spark, sf))


@query
def session_keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    params = sessions.SessionFilter(keywords=("kw1", "kw4"))
    return _session_row(sessions.filter_sessions(_enriched(spark, sf), params))


@query
def session_category_filter(spark: SparkSession, sf: str) -> DataFrame:
    params = sessions.SessionFilter(category_ids=(3, 14, 15), sex=("male",))
    return _session_row(sessions.filter_sessions(_enriched(spark, sf), params))


@query
def session_condition_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(
        sessions.filter_conditions(
            _enriched(spark, sf), "age:20-60", "sex:male", "professional:BUILDING"
        )
    )


@query
def filtered_session_actions(spark: SparkSession, sf: str) -> DataFrame:
    chosen = sessions.of_sessions(b.actions(spark, sf, cities=True), _filtered(spark, sf))
    return chosen.select(
        _date(), "user_id", "session_id", "page_id",
        fn.format_time(F.col("action_time")).alias("action_time"), "search_keyword",
        "click_category_id", "order_category_ids", "pay_category_ids", "city_id",
    )


@query
def session_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_histogram(_filtered(spark, sf))


@query
def session_histogram_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The histogram with hour-scale visit buckets and single steps."""
    return sessions.session_histogram(_filtered(spark, sf), WIDE_VISITS, NARROW_STEPS)


@query
def session_histogram_searched(spark: SparkSession, sf: str) -> DataFrame:
    """The histogram of sessions with given keywords and categories, without building lists."""
    params = sessions.SessionFilter(keywords=("kw1", "kw4"), category_ids=tuple(range(50)))
    grouped = sessions.aggregate_sessions(b.actions(spark, sf), params)
    enriched = sessions.join_users(grouped, b.user_info(spark, sf))
    return sessions.session_histogram(
        sessions.filter_sessions(enriched, params), WIDE_VISITS, NARROW_STEPS
    )


@query
def session_aggr_stat(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_aggr_stat(sessions.session_histogram(_filtered(spark, sf)))


@query
def session_histogram_percent(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.histogram_percent(
        sessions.session_histogram(_filtered(spark, sf), WIDE_VISITS, NARROW_STEPS)
    )


# --- categories -----------------------------------------------------------


@query
def category_order_counts(spark: SparkSession, sf: str) -> DataFrame:
    return categories.category_order_counts(b.actions(spark, sf))


@query
def category_pay_counts(spark: SparkSession, sf: str) -> DataFrame:
    return categories.category_pay_counts(b.actions(spark, sf))


@query
def top10_categories(spark: SparkSession, sf: str) -> DataFrame:
    return categories.top_categories(categories.sum_sessions(_filtered_pairs(spark, sf)))


@query
def top10_category_sessions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = tables.materialize(_filtered_pairs(spark, sf), "pairs")
    top = categories.top_categories(categories.sum_sessions(pairs))
    return categories.top_category_sessions(pairs, top)


# --- page flow ------------------------------------------------------------


@query
def page_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pageflow.page_split_counts(b.actions(spark, sf), FLOW)


@query
def start_page_visits(spark: SparkSession, sf: str) -> DataFrame:
    return pageflow.start_page_visits(b.actions(spark, sf), FLOW)


@query
def page_convert_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = pageflow.page_convert_rate(b.actions(spark, sf), FLOW)
    return rates.select(F.col("step_no").cast("bigint").alias("step_no"), "page_split", "pv", "convert_rate")


# --- area -----------------------------------------------------------------


@query
def area_level_label(spark: SparkSession, sf: str) -> DataFrame:
    """Every product click with its city, area and area level, counted per city."""
    clicks = b.product_clicks(spark, sf).groupBy("city_id").agg(F.count(F.lit(1)).alias("click_count"))
    return clicks.join(b.city_info(spark, sf), "city_id").select(
        F.col("city_id").cast("bigint").alias("city_id"), "city_name", "area",
        area.area_level(F.col("area"), b.REGION_LEVELS).alias("area_level"), "click_count",
    )


@query
def area_product_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return area.area_product_clicks(
        b.product_clicks(spark, sf), b.city_info(spark, sf), b.REGION_LEVELS
    ).drop("city_infos")


@query
def area_top3_products(spark: SparkSession, sf: str) -> DataFrame:
    return area.area_top_products(
        b.product_clicks(spark, sf), b.city_info(spark, sf), b.product_info(spark, sf),
        levels=b.REGION_LEVELS,
    ).withColumn("product_status", F.col("product_status").cast("bigint"))


@query
def area_top3_clicked(spark: SparkSession, sf: str) -> DataFrame:
    """The same report over the click log, as the session job runs it."""
    clicks = area.product_clicks(b.actions(spark, sf, cities=True))
    return area.area_top_products(
        clicks, b.city_info(spark, sf), b.product_info(spark, sf), levels=b.REGION_LEVELS
    ).withColumn("product_status", F.col("product_status").cast("bigint"))


# --- sampling -------------------------------------------------------------


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.aggregate_sessions(b.actions(spark, sf))


@query
def sessions_per_hour(spark: SparkSession, sf: str) -> DataFrame:
    hours = sampling.sessions_per_hour(_sessions(spark, sf))
    return hours.select(_date(), F.col("hour").cast("bigint").alias("hour"), "session_count")


@query
def hour_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = sampling.hour_share(_sessions(spark, sf), HOUR_SAMPLE)
    return shares.withColumn("hour", F.col("hour").cast("bigint"))


@query
def sample_quota(spark: SparkSession, sf: str) -> DataFrame:
    quota = sampling.sample_quota(_sessions(spark, sf), SAMPLE)
    return quota.select(_date(), F.col("hour").cast("bigint").alias("hour"), "session_count", "quota")


@query
def session_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _session_row(sampling.session_sample(_sessions(spark, sf), SAMPLE))


@query
def session_sample_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    sample = sampling.session_sample_by_hour(_sessions(spark, sf), HOUR_SAMPLE)
    return _session_row(sample).withColumn("hour", F.col("hour").cast("bigint"))


@query
def session_sample_detail(spark: SparkSession, sf: str) -> DataFrame:
    actions = b.actions(spark, sf)
    detail = sampling.session_sample_detail(actions, sessions.aggregate_sessions(actions), SAMPLE)
    return detail.withColumn("action_time", fn.format_time(F.col("action_time")))


# --- text, JSON, task parameters ------------------------------------------


@query
def session_record_encode(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.encode_sessions(_enriched(spark, sf))


@query
def session_record_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as text, read back and decoded."""
    path = scratch_dir(spark, "session-text")
    tables.write_session_text(sessions.encode_sessions(_enriched(spark, sf)), path)
    return _session_row(sessions.decode_sessions(readers.read_session_text(spark, path)))


@query
def session_record_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Single fields read from and set in the text record."""
    lines = sessions.encode_sessions(_enriched(spark, sf))
    info = F.get(F.split("value", sessions.SEPARATOR, 2), F.lit(1))
    return lines.select(
        fn.get_field(info, "sessionid").alias("session_id"),
        fn.get_field(info, "searchKeywords").alias("keywords"),
        fn.get_field(info, "absent").alias("absent"),
        fn.set_field(info, "city", F.lit("X$1")).alias("changed"),
    )


@query
def scalar_text_dates(spark: SparkSession, sf: str) -> DataFrame:
    orders = b.table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    millis = F.unix_millis(at) + 789
    commas = F.concat(F.lit(","), F.col("o_orderpriority"), F.lit(","))
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    number = (F.col("o_orderkey") % 100).cast("string")
    return orders.select(
        "o_orderkey",
        fn.is_empty(priority).alias("no_priority"),
        fn.is_not_empty(priority).alias("has_priority"),
        fn.trim_comma(commas).alias("trimmed"),
        fn.pad_two(number).alias("two_digits"),
        fn.format_date(at).alias("order_date"),
        fn.format_time(at).alias("order_time"),
        fn.format_time(fn.parse_time(F.date_format(at, "yyyy-MM-dd H:mm:ss"))).alias("parsed_time"),
        fn.date_hour(at).alias("date_hour"),
        fn.date_key(at).alias("date_key"),
        fn.format_date(fn.parse_date_key(fn.date_key(at))).alias("parsed_key"),
        fn.time_minute(at).alias("minute_key"),
        fn.format_time(fn.millis_to_time(millis)).alias("stamp"),
        fn.is_before(at, base).alias("before_base"),
        fn.is_after(at, base).alias("after_base"),
        fn.minus_seconds(at, base).alias("seconds_from_base"),
        fn.format_double(F.col("o_totalprice") / 7, 2).alias("price_rounded"),
        fn.minus_seconds(fn.today().cast("timestamp"), fn.yesterday().cast("timestamp")).alias("day_seconds"),
    )


@query
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    products = area.product_status(b.product_info(spark, sf))
    return products.select(
        "product_id", "product_name",
        F.col("product_status").cast("bigint").alias("product_status"),
        fn.product_status_label(F.col("product_status")).alias("product_status_label"),
    )


@query
def task_params(spark: SparkSession, sf: str) -> DataFrame:
    """Typed parameters of every task."""
    params = tasks.task_params(b.tasks(spark, sf))
    ages = {c: F.col(c).cast("bigint") for c in ("start_age", "end_age")}
    return params.withColumns({**ages, "start_date": _date("start_date"), "end_date": _date("end_date")})


# --- ad clicks ------------------------------------------------------------


@query
def ad_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ads.parse_ad_lines(b.ad_lines(spark, sf))
    return parsed.withColumns({"date": _date(), "event_time": fn.format_time(F.col("event_time"))})


@query
def ad_log_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ads.rejected_ad_lines(b.ad_lines(spark, sf))


@query
def ad_user_daily_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return ads.user_daily_clicks(b.bare_clicks(spark, sf)).withColumn("date", _date())


@query
def ad_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    return ads.blacklist(b.bare_clicks(spark, sf), THRESHOLD)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    clicks = b.bare_clicks(spark, sf)
    return b.place(spark, sf, ads.drop_listed(clicks, ads.blacklist(clicks, THRESHOLD))).select(*ads.CLICK_COLUMNS)


def _click_row(clicks: DataFrame) -> DataFrame:
    return clicks.withColumns({"date": _date(), "event_time": fn.format_time(F.col("event_time"))})


@query
def ad_blacklist_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _click_row(_clean(spark, sf))


@query
def ad_stat(spark: SparkSession, sf: str) -> DataFrame:
    return ads.ad_stat(_clean(spark, sf)).withColumn("date", _date())


@query
def ad_province_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ads.province_counts(ads.ad_stat(_clean(spark, sf))).withColumn("date", _date())


@query
def ad_province_top3(spark: SparkSession, sf: str) -> DataFrame:
    return ads.province_top(ads.ad_stat(_clean(spark, sf))).withColumn("date", _date())


def _trend_row(trend: DataFrame) -> DataFrame:
    return trend.withColumns(
        {"date": _date(), "hour": F.col("hour").cast("bigint"), "minute": F.col("minute").cast("bigint")}
    )


@query
def ad_click_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _trend_row(ads.click_trend(_clean(spark, sf)))


@query
def ad_click_trend_last_hour(spark: SparkSession, sf: str) -> DataFrame:
    newest = b.newest_click(spark, sf)
    recent = b.bare_clicks(spark, sf, *ads.minute_range(newest)) if newest else b.bare_clicks(spark, sf)
    listed = ads.blacklist(b.bare_clicks(spark, sf), THRESHOLD)
    return _trend_row(ads.click_trend(ads.drop_listed(recent, listed)))


# --- ad stream ------------------------------------------------------------


def _arrivals(spark: SparkSession, sf: str) -> Iterator[str]:
    """A folder where the ad lines arrive in three parts by time; yields after each."""
    landing = scratch_dir(spark, "ad-landing")
    lines = b.ad_lines(spark, sf)
    at = F.timestamp_millis(F.get(F.split("value", " "), F.lit(0)).cast("bigint"))
    edges = [F.lit(d).cast("timestamp") for d in ARRIVALS]
    for arrived in (at < edges[0], (at >= edges[0]) & (at < edges[1]), at >= edges[1]):
        lines.where(arrived).write.mode("append").text(landing)
        yield landing


def _streamed(spark: SparkSession, sf: str, *steps: str, keep: str | None = None) -> ad_stream.AdTables:
    """The tables after three arrivals, each worked off by queries started anew from their checkpoints."""
    out = ad_stream.AdTables(scratch_dir(spark, "ad-stream"))
    for landing in _arrivals(spark, sf):
        clicks = ads.parse_ad_lines(readers.read_text_stream(spark, landing), F.current_timestamp())
        ad_stream.run_available(spark, clicks, out, THRESHOLD, keep, steps)
    return out


@query
def ad_user_daily_clicks_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "gate").user_click_count(spark).withColumn("date", _date())


@query
def ad_blacklist_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "gate").blacklist(spark)


@query
def ad_blacklist_filter_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _click_row(_streamed(spark, sf, "gate").clean(spark))


@query
def ad_stat_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "gate", "stats").stat(spark).withColumn("date", _date())


@query
def ad_province_top3_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "gate", "province_top").province_top3(spark).withColumn("date", _date())


@query
def ad_click_trend_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _trend_row(_streamed(spark, sf, "gate", "trend").trend(spark))


@query
def ad_click_trend_hour_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Clean clicks of the last hour, per minute, after the third arrival."""
    return _trend_row(_streamed(spark, sf, "trend_hour").trend_hour(spark))


@query
def ad_late_clicks_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks of days that were closed when they came: the lines arrive with the newest part first."""
    out = ad_stream.AdTables(scratch_dir(spark, "ad-late"))
    landing = scratch_dir(spark, "ad-landing")
    lines = b.ad_lines(spark, sf)
    at = F.timestamp_millis(F.get(F.split("value", " "), F.lit(0)).cast("bigint"))
    middle = F.lit(ARRIVALS[1]).cast("timestamp")
    for arrived in (at >= middle, at < middle):
        lines.where(arrived).write.mode("append").text(landing)
        clicks = ads.parse_ad_lines(readers.read_text_stream(spark, landing), F.current_timestamp())
        ad_stream.run_available(spark, clicks, out, THRESHOLD, KEEP, ("gate",))
    return _click_row(out.late(spark))


@query
def ad_log_rejects_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = ad_stream.AdTables(scratch_dir(spark, "ad-rejects")).create(spark)
    for landing in _arrivals(spark, sf):
        ad_stream.start_rejects(readers.read_text_stream(spark, landing), out, once=True).awaitTermination()
    return out.rejects(spark)


@query
def ad_restart(spark: SparkSession, sf: str) -> DataFrame:
    """User counts of a stream that closes days, resumed from the checkpoint after every arrival."""
    return _streamed(spark, sf, "gate", keep=KEEP).user_click_count(spark).withColumn("date", _date())


# --- sinks ----------------------------------------------------------------


@query
def sink_append_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two tasks appended to the same result tables and read back."""
    base = scratch_dir(spark, "results")
    for task_id, actions in ((1, b.actions(spark, sf)), (2, b.actions(spark, sf, *DATES))):
        top = categories.top_categories(categories.category_counts(actions))
        tables.append_result(top, base, "top10_category", task_id)
    return spark.read.parquet(f"{base}/top10_category")


def _session_table(spark: SparkSession, sf: str, table: str, params: sessions.SessionFilter) -> DataFrame:
    """One result table of the session job, appended and read back."""
    base = scratch_dir(spark, "results")
    jobs.store_session_results(
        b.actions(spark, sf, cities=True), b.user_info(spark, sf), b.city_info(spark, sf), b.product_info(spark, sf),
        params, base, 1, SAMPLE, only=(table,),
    )
    return spark.read.parquet(f"{base}/{table}")


@query
def sink_session_aggr_stat(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(spark, sf, "session_aggr_stat", FILTER)


@query
def sink_session_random_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(spark, sf, "session_random_extract", sessions.SessionFilter())


@query
def sink_session_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(spark, sf, "session_detail", sessions.SessionFilter())


@query
def sink_top10_category(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(spark, sf, "top10_category", FILTER)


@query
def sink_top10_category_session(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(spark, sf, "top10_category_session", FILTER)


@query
def sink_area_top3_product(spark: SparkSession, sf: str) -> DataFrame:
    rows = _session_table(spark, sf, "area_top3_product", sessions.SessionFilter())
    # the level is that of the job's own areas, and the cities are listed in no order
    return rows.drop("area_level", "city_infos").withColumn("product_status", F.col("product_status").cast("bigint"))


@query
def sink_page_split_convert_rate(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "results")
    rates = pageflow.convert_rate_text(pageflow.page_convert_rate(b.actions(spark, sf), FLOW))
    tables.append_result(rates, base, "page_split_convert_rate", 1)
    return spark.read.parquet(f"{base}/page_split_convert_rate")


@query
def sink_upsert_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Morning totals, overwritten by the day's totals where a key has afternoon clicks."""
    path = tables.ensure_table(spark, scratch_dir(spark, "upsert"))
    clicks = b.ad_clicks(spark, sf)
    morning = F.hour("event_time") < 12
    keys = ad_stream.STAT_KEYS
    tables.write_version(ads.ad_stat(clicks.where(morning)), path, 0, ["date"])
    later = clicks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("click_count"), F.count_if(~morning).alias("late")
    )
    tables.write_version(later.where(F.col("late") > 0).drop("late"), path, 2, ["date"])
    return tables.read_upserted(spark, path, schemas.AD_STAT, keys).withColumn("date", _date())


@query
def sink_replace_group_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Top ads of the mornings, then replaced for every group of the last days."""
    path = scratch_dir(spark, "replace")
    clicks = b.ad_clicks(spark, sf)
    early = clicks.where(F.hour("event_time") < 12)
    late = clicks.where(F.col("date") >= F.lit("2024-01-16").cast("date"))
    for version, part in ((0, early), (2, late)):
        tables.write_version(ads.province_top(ads.ad_stat(part)), path, version, ["date"])
    stored = tables.read_replaced(spark, path, schemas.AD_PROVINCE_TOP3, ad_stream.TOP_GROUP)
    return stored.withColumn("date", _date())


@query
def sink_insert_absent_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping sets of users inserted one after the other."""
    path = tables.ensure_table(spark, scratch_dir(spark, "absent"))
    daily = ads.user_daily_clicks(b.ad_clicks(spark, sf))
    for version, threshold in ((0, THRESHOLD + 1), (2, THRESHOLD)):
        tables.insert_absent(
            ads.over_limit_users(daily, threshold), path, schemas.AD_BLACKLIST, ["user_id"], version
        )
    return spark.read.schema(schemas.AD_BLACKLIST).parquet(path).select("user_id")
