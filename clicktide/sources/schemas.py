"""Declared schemas of the input tables, the result tables and the stream tables."""

from __future__ import annotations

from pyspark.sql import types as T

ACTIONS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("action_time", T.TimestampType()),
    T.StructField("search_keyword", T.StringType()),
    T.StructField("click_category_id", T.LongType()),
    T.StructField("click_product_id", T.LongType()),
    T.StructField("order_category_ids", T.StringType()),
    T.StructField("order_product_ids", T.StringType()),
    T.StructField("pay_category_ids", T.StringType()),
    T.StructField("pay_product_ids", T.StringType()),
    T.StructField("city_id", T.LongType()),
])

USER_INFO = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("professional", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("sex", T.StringType()),
])

PRODUCT_INFO = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("extend_info", T.StringType()),
])

CITY_INFO = T.StructType([
    T.StructField("city_id", T.IntegerType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("area", T.StringType()),
])

TASK = T.StructType([
    T.StructField("task_id", T.LongType()),
    T.StructField("task_name", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("finish_time", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("task_status", T.StringType()),
    T.StructField("task_param", T.StringType()),
])

# Input tables a job reads by name.
INPUT_TABLES = {
    "user_visit_action": ACTIONS,
    "user_info": USER_INFO,
    "product_info": PRODUCT_INFO,
    "city_info": CITY_INFO,
    "task": TASK,
}

# Columns of the result tables, in order.
RESULT_COLUMNS = {
    "session_aggr_stat": (
        "task_id", "session_count",
        "visit_length_1s_3s_ratio", "visit_length_4s_6s_ratio", "visit_length_7s_9s_ratio",
        "visit_length_10s_30s_ratio", "visit_length_30s_60s_ratio", "visit_length_1m_3m_ratio",
        "visit_length_3m_10m_ratio", "visit_length_10m_30m_ratio", "visit_length_30m_ratio",
        "step_length_1_3_ratio", "step_length_4_6_ratio", "step_length_7_9_ratio",
        "step_length_10_30_ratio", "step_length_30_60_ratio", "step_length_60_ratio",
    ),
    "session_random_extract": (
        "task_id", "session_id", "start_time", "search_keywords", "click_category_ids",
    ),
    "session_detail": (
        "task_id", "user_id", "session_id", "page_id", "action_time", "search_keyword",
        "click_category_id", "click_product_id", "order_category_ids", "order_product_ids",
        "pay_category_ids", "pay_product_ids",
    ),
    "top10_category": ("task_id", "category_id", "click_count", "order_count", "pay_count"),
    "top10_category_session": ("task_id", "category_id", "session_id", "click_count"),
    "page_split_convert_rate": ("task_id", "convert_rate"),
    "area_top3_product": (
        "task_id", "area", "area_level", "product_id", "city_infos", "click_count",
        "product_name", "product_status",
    ),
}

# Tables the ad stream maintains: schema, key columns, partition columns.
AD_USER_CLICK_COUNT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("click_count", T.LongType()),
])
AD_BLACKLIST = T.StructType([T.StructField("user_id", T.LongType())])
AD_STAT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("province", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("click_count", T.LongType()),
])
AD_PROVINCE_TOP3 = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("province", T.StringType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("click_count", T.LongType()),
])
AD_CLICK_TREND = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("minute", T.IntegerType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("click_count", T.LongType()),
])
AD_CLICKS = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("date", T.DateType()),
    T.StructField("province", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("ad_id", T.LongType()),
])
