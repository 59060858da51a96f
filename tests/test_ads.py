from datetime import datetime, timedelta

from fixtures import clicks, lines, tuples

from clicktide.operators import ads
from pyspark.sql import functions as F

T = datetime(2018, 12, 17, 13, 27, 57)


def test_parse(spark):
    text = lines(
        spark, "1545053277205 Henan Zhengzhou 5 1", "1545053277205 Henan Zhengzhou 5",
        "x Henan Zhengzhou 5 1", "1545053277205 Henan Zhengzhou u 1", "", "1545053277205 a b 1 2 3",
    )
    assert tuples(ads.parse_ad_lines(text)) == [(T, T.date(), "Henan", "Zhengzhou", 5, 1)]
    assert ads.rejected_ad_lines(text).count() == 5


def click(user, ad, days=0, seconds=0, province="P", city="C"):
    return (T + timedelta(days=days, seconds=seconds), province, city, user, ad)


def test_blacklist(spark):
    frame = clicks(
        spark,
        *[click(1, 1)] * 3,                     # exactly at the threshold
        *[click(2, 1)] * 4,                     # one above
        *[click(3, 1)] * 3, *[click(3, 2)] * 3,  # two ads below
        *[click(4, 1)] * 2, *[click(4, 1, days=1)] * 2,  # across midnight
        *[click(5, 1)] * 4, *[click(5, 2)] * 4,  # over on two ads, listed once
    )
    assert tuples(ads.blacklist(frame, 3)) == [(2,), (5,)]
    assert ads.blacklist(frame).count() == 0
    kept = ads.drop_listed(frame, ads.blacklist(frame, 3))
    assert kept.columns == frame.columns
    assert {r.user_id for r in kept.collect()} == {1, 3, 4} and kept.count() == 13


def test_counts(spark):
    frame = clicks(
        spark, click(1, 1), click(2, 1), click(3, 1, city="D"), click(1, 2), click(1, 3), click(1, 4),
        click(1, 1, province="Q"), click(1, 9, days=1),
    )
    stat = ads.ad_stat(frame)
    assert stat.count() == 7
    assert sum(r.click_count for r in stat.collect()) == frame.count()
    provinces = ads.province_counts(stat)
    assert {(r.province, r.ad_id): r.click_count for r in provinces.collect() if r.date == T.date()} == {
        ("P", 1): 3, ("P", 2): 1, ("P", 3): 1, ("P", 4): 1, ("Q", 1): 1}
    top = {(r.date.day, r.province, r.ad_id) for r in ads.province_top(stat).collect()}
    assert top == {(17, "P", 1), (17, "P", 2), (17, "P", 3), (17, "Q", 1), (18, "P", 9)}


def test_lines_out_of_range(spark):
    """A year far ahead, numbers no time can hold, and blanks at the end."""
    text = lines(
        spark, "99999999999999999 a b 1 1", "-5 a b 1 1", "32503680000000 a b 1 1", "1545053277205 a b 1 1 ",
        "9223372036854775807 a b 1 1", "99999999999999999999 a b 1 1",
    )
    assert [r.event_time.year for r in ads.parse_ad_lines(text).collect()] == [3000, 2018]
    arrival = F.lit("2018-12-18 00:00:00").cast("timestamp")
    assert [r.event_time.year for r in ads.parse_ad_lines(text, arrival).collect()] == [2018]
    assert ads.rejected_ad_lines(text, arrival).count() == 5
    assert ads.rejected_ad_lines(text).count() == 4


def test_last_minutes(spark):
    frame = clicks(spark, click(1, 1), click(1, 1, seconds=-3540), click(1, 1, seconds=-3600), click(1, 2, seconds=2))
    whole = ads.recent_trend(ads.click_trend(frame))
    assert tuples(ads.click_trend(ads.last_minutes(frame))) == tuples(whole)
    assert ads.last_minutes(frame.where("false")).count() == 0
    assert ads.last_minutes(frame, 1, T).count() == 2


def test_trend(spark):
    frame = clicks(spark, click(1, 1), click(2, 1, seconds=2), click(1, 1, seconds=3), click(1, 1, seconds=-3600),
                   click(1, 1, seconds=-3500))
    trend = ads.click_trend(frame)
    got = {(r.hour, r.minute): r.click_count for r in trend.collect()}
    assert got == {(13, 27): 2, (13, 28): 1, (12, 27): 1, (12, 29): 1}
    recent = {(r.hour, r.minute) for r in ads.recent_trend(trend).collect()}
    assert recent == {(13, 27), (13, 28), (12, 29)}
    assert ads.recent_trend(trend, 1).count() == 1
