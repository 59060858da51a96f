"""Relations that hold on any data, checked on the given tables."""

import pytest
from fixtures import tuples
from pyspark.sql import functions as F

from clicktide.operators import ads, categories, pageflow, sampling, sessions
from clicktide.plans import bindings as b

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def log(spark):
    return b.actions(spark, SF).persist()


@pytest.fixture(scope="module")
def enriched(spark, log):
    return sessions.join_users(sessions.aggregate_sessions(log), b.user_info(spark, SF)).persist()


@pytest.fixture(scope="module")
def clicks(spark):
    return b.ad_clicks(spark, SF).persist()


def test_buckets_cover_all_sessions(enriched):
    row = sessions.session_histogram(enriched).first().asDict()
    visits = sum(v for k, v in row.items() if k.startswith("visit"))
    steps = sum(v for k, v in row.items() if k.startswith("step"))
    short = enriched.where("visit_length_ms < 1000").count()
    assert visits + short == steps == row["session_count"] == enriched.count()


def test_steps_sum_to_the_log(log, enriched):
    assert enriched.agg(F.sum("step_length")).first()[0] == log.count()


def test_filter_keeps_a_subset(enriched):
    kept = sessions.filter_sessions(enriched, sessions.SessionFilter(start_age=20, end_age=60))
    assert 0 < kept.count() < enriched.count()
    assert kept.join(enriched, "session_id", "left_anti").count() == 0


def test_every_action_has_one_predecessor_row(log, enriched):
    pages = pageflow.previous_pages(log)
    assert pages.count() == log.count()
    assert pages.where("prev_page is null").count() == enriched.count()


def test_partitions_do_not_change_counts(spark, log):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "29"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(tuples(pageflow.page_split_counts(log, (2, 3, 4))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_category_totals(log):
    counts = categories.category_counts(log).agg(F.sum("click_count"), F.sum("order_count")).first()
    assert counts[0] == log.where("click_category_id is not null").count()
    assert counts[1] == 2 * log.where("order_category_ids is not null").count()


def test_sample_stays_within_quota(log):
    frame = sessions.aggregate_sessions(log)
    quota = {(r.date, r.hour): r.quota for r in sampling.sample_quota(frame, 3000).collect()}
    drawn = sampling.sessions_per_hour(sampling.session_sample(frame, 3000)).collect()
    assert {(r.date, r.hour): r.session_count for r in drawn} == {k: q for k, q in quota.items() if q}
    assert sum(quota.values()) <= 3000


def test_no_listed_user_passes(clicks):
    listed = ads.blacklist(clicks, 2)
    kept = ads.drop_listed(clicks, listed)
    assert kept.join(listed, "user_id", "left_semi").count() == 0
    gone = clicks.join(listed, "user_id", "left_semi").count()
    assert kept.count() + gone == clicks.count()


def test_sums_agree_at_every_level(clicks):
    stat = ads.ad_stat(clicks)
    sums = {
        frame.agg(F.sum("click_count")).first()[0]
        for frame in (stat, ads.province_counts(stat), ads.click_trend(clicks), ads.user_daily_clicks(clicks))
    }
    assert sums == {clicks.count()}
