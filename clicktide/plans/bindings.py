"""The click-log data model as views over the given tables.

No table here is a click log, so ``events`` stands in: a session is 24 hours of
a user from an hour of the user's own, so that most sessions cross midnight;
``props.k`` (0 to 99) is category and product, and the event type says which page
was seen and which of the action's columns are filled.  A user is a customer, and
the city of an action or click is the customer's nation.

Sessions cut at gaps of silence (operators/gaps.py) need the log in order before a
query begins, so these are a plain expression, and the ``gap_*`` queries cut them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.operators.ads import CLICK_COLUMNS
from clicktide.sources.readers import time_in_dates

# Fixed page of each event type.
PAGES = {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": 5}

# Level labels of the five regions.
REGION_LEVELS = {"AFRICA": "A", "AMERICA": "B", "ASIA": "C", "EUROPE": "D", "MIDDLE EAST": "E"}


# Declared, so that no query starts by reading footers for a schema.
SCHEMAS = {
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city of each user."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("city_id")
    )


def session_id() -> Column:
    """User and number of the user's day, which begins at the hour ``user_id % 24``."""
    shifted = F.unix_seconds(F.col("ts").cast("timestamp")) - F.pmod(F.col("user_id"), F.lit(24)) * 3600
    day = F.floor(shifted / 86400)
    return F.concat_ws("-", F.col("user_id").cast("string"), day.cast("string"))


def actions(
    spark: SparkSession,
    sf_dir: str,
    start: str | None = None,
    end: str | None = None,
    cities: bool = False,
) -> DataFrame:
    """``user_visit_action``: a projection of ``events``.

    A date range becomes a range on the stored time column, so the scan can
    skip row groups.  With ``cities`` the user's city is joined.
    """
    events = table(spark, sf_dir, "events").where(time_in_dates("ts", start, end))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    page = F.coalesce(*[F.when(kind == name, F.lit(no).cast("bigint")) for name, no in PAGES.items()])
    one = k.cast("string")
    pair = F.concat_ws(",", one, ((k + 7) % 100).cast("string"))
    log = events.select(
        F.to_date("ts").alias("date"),
        "user_id",
        session_id().alias("session_id"),
        page.alias("page_id"),
        F.col("ts").cast("timestamp").alias("action_time"),
        F.when(kind == "view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        F.when(kind == "click", k).alias("click_category_id"),
        F.when(kind == "click", k).alias("click_product_id"),
        F.when(kind == "signup", pair).alias("order_category_ids"),
        F.when(kind == "signup", pair).alias("order_product_ids"),
        F.when(kind == "purchase", one).alias("pay_category_ids"),
        F.when(kind == "purchase", one).alias("pay_product_ids"),
    )
    return log.join(_homes(spark, sf_dir), "user_id", "left").select(*log.columns, "city_id") if cities else log


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event, user and time of the log."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("action_time"))


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` with its nation as city."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.col("n_name").alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("male")).otherwise(F.lit("female")).alias("sex"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` with its region as area."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("area"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with a JSON status text."""
    status = (F.col("p_partkey") % 2).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat(F.lit('{"product_status": '), status, F.lit("}")).alias("extend_info"),
    )


def product_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product click per line item, in the nation of the customer who ordered it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    homes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("c_nationkey").alias("city_id"), F.col("l_partkey").alias("product_id")
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task record per customer; some parameters are absent, some are lists."""
    key = F.col("c_custkey")
    age = F.floor(F.col("c_acctbal") / 100).cast("string")
    optional_age = F.when(
        key % 3 != 0, F.concat(F.lit('"startAge":["'), age, F.lit('"],"endAge":["60"],'))
    ).otherwise(F.lit(""))
    param = F.concat(
        F.lit('{"startDate":["2024-01-01"],'),
        optional_age,
        F.lit('"professionals":["'), F.col("c_mktsegment"), F.lit(',BUILDING"],"cities":["NATION_'),
        F.col("c_nationkey").cast("string"),
        F.lit('","NATION_0"],"keywords":[],"targetPageFlow":["1,2,3"]}'),
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"),
        F.col("c_name").alias("task_name"),
        F.lit(None).cast("string").alias("create_time"),
        F.lit(None).cast("string").alias("start_time"),
        F.lit(None).cast("string").alias("finish_time"),
        F.lit("session").alias("task_type"),
        F.lit("new").alias("task_status"),
        param.alias("task_param"),
    )


# --- ad clicks ------------------------------------------------------------


def place(spark: SparkSession, sf_dir: str, clicks: DataFrame) -> DataFrame:
    """``clicks`` with the city and province of their users."""
    places = city_info(spark, sf_dir).select(
        F.col("city_id").cast("bigint").alias("city_id"),
        F.col("city_name").alias("city"),
        F.regexp_replace("area", " ", "_").alias("province"),
    )
    homes = _homes(spark, sf_dir).join(places, "city_id").select("user_id", "province", "city")
    return clicks.join(homes, "user_id")


def _ad_id() -> Column:
    return (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("ad_id")


def newest_click(spark: SparkSession, sf_dir: str) -> datetime | None:
    """Time of the newest event, cut to the second."""
    newest = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return newest and newest.replace(microsecond=0)


def bare_clicks(
    spark: SparkSession, sf_dir: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Events as ad clicks without their place; a time range reaches the scan."""
    events = table(spark, sf_dir, "events")
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start.isoformat(" ")).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") < F.lit(end.isoformat(" ")).cast("timestamp_ntz"))
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.date_trunc("second", at).alias("event_time"), F.to_date(at).alias("date"), "user_id", _ad_id()
    )


def ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a typed ad click."""
    return place(spark, sf_dir, bare_clicks(spark, sf_dir)).select(*CLICK_COLUMNS)


def ad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an ad text line; lines of error events lack their last field."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.when(F.col("event_type") != "error", _ad_id()).alias("ad_id"),
    )
    fields = [F.col(c).cast("string") for c in ("ms", "province", "city", "user_id", "ad_id")]
    return place(spark, sf_dir, events).select(F.concat_ws(" ", *fields).alias("value"))
