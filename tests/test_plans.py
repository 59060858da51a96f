"""Shapes of the physical plans."""

import pytest
from pyspark.sql import functions as F

from clicktide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WRITES = ("sink_", "ad_restart", "session_record_decode", "top10_category_sessions")


def plan(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(n for n in QUERIES if not n.endswith("_stream") and not n.startswith(WRITES))


@pytest.mark.parametrize("name", BATCH)
def test_stays_in_the_jvm_without_nested_loops(spark, name):
    text = plan(spark, name)
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", ["top10_category_sessions", "area_top3_products", "ad_province_top3"])
def test_rank_filter_cuts_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_category_counts_scan_once(spark):
    from clicktide.operators.categories import category_counts
    from clicktide.plans import bindings

    text = category_counts(bindings.actions(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_filter_on_hits_builds_no_lists(spark):
    assert "collect_set" not in plan(spark, "session_histogram_searched")


def test_histogram_reads_no_lists(spark):
    text = plan(spark, "session_histogram")
    assert "collect_set" not in text and "props" not in text


def test_date_range_reaches_the_scan(spark):
    text = plan(spark, "action_date_range")
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThan(ts,2024-01-21T00:00)" in text


def test_the_last_hour_reaches_the_scan(spark):
    text = plan(spark, "ad_click_trend_last_hour")
    assert "GreaterThanOrEqual(ts,2024-01-30T22:27" in text and "LessThan(ts,2024-01-30T23:27" in text


def test_page_flow_scans_once(spark):
    df = QUERIES["page_convert_rate"](spark, SF_DIR)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # rows are range-partitioned once and linked inside their partitions
    assert text.count("FileScan") == 1
    assert text.count("rangepartitioning(session_id") == 1
    assert "SinglePartition" not in "".join(x for x in text.split("\n") if "session_id" in x)


@pytest.fixture
def small_limits(spark):
    """Shuffled joins, and partitions that count as skewed at test size."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("operator", ["join_users", "of_sessions", "drop_listed"])
def test_a_hot_key_is_split(spark, small_limits, operator):
    """One key holds a third of all rows; the join reads its partition in pieces."""
    from clicktide.operators import ads, sessions

    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
    rows = spark.range(0, 60000, 1, 16).select(
        key.alias("user_id"), key.cast("string").alias("session_id"), F.md5(F.col("id").cast("string")).alias("x")
    )
    keys = spark.range(0, 5000, 1, 4).select(
        F.col("id").alias("user_id"), F.col("id").cast("string").alias("session_id"),
        *[F.lit("v").alias(c) for c in ("age", "professional", "city", "sex")],
    )
    joined = {
        "join_users": lambda: sessions.join_users(rows, keys),
        "of_sessions": lambda: sessions.of_sessions(rows, keys),
        "drop_listed": lambda: ads.drop_listed(rows, keys.where("user_id > 10")),
    }[operator]()
    text = final_plan(joined)
    assert "SortMergeJoin(skew=true)" in text
    assert joined.count() == (20000 + sum(1 for i in range(60000) if i % 3 and i % 5000 <= 10)
                              if operator == "drop_listed" else 60000)


def test_a_hot_hour_meets_as_its_quota_only(spark):
    """All sessions in one hour: the ranking reads little more than its quota."""
    from clicktide.operators.sampling import session_sample

    frame = spark.range(0, 50000, 1, 8).select(
        F.col("id").cast("string").alias("session_id"),
        F.lit("2024-01-01 05:00:00").cast("timestamp").alias("start_time"),
        F.array().cast("array<string>").alias("search_keywords"),
        F.array().cast("array<bigint>").alias("click_category_ids"),
    )
    sample = session_sample(frame, 100)
    assert sample.count() == 100
    assert "sample-near" in sample._jdf.queryExecution().toString()
