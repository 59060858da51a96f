from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clicktide import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, empty", [(None, True), ("", True), ("a", False), (" ", False)])
def test_empty(spark, text, empty):
    s = F.lit(text).cast("string")
    assert value(spark, fn.is_empty(s)) is empty
    assert value(spark, fn.is_not_empty(s)) is not empty


@pytest.mark.parametrize(
    "text, want", [(",a,b,", "a,b"), ("a,b", "a,b"), (",,a,,", ",a,"), ("", ""), (",", "")]
)
def test_trim_comma(spark, text, want):
    assert value(spark, fn.trim_comma(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("7", "07"), ("12", "12"), ("123", "0123")])
def test_pad_two(spark, text, want):
    assert value(spark, fn.pad_two(F.lit(text))) == want


RECORD = "sessionid=s1|searchKeywords=|clickCategoryIds=1,2|age=20|bad=a=b|"


@pytest.mark.parametrize(
    "field, want",
    [("sessionid", "s1"), ("searchKeywords", None), ("clickCategoryIds", "1,2"), ("age", "20"),
     ("none", None), ("id", None), ("bad", None)],
)
def test_get_field(spark, field, want):
    assert value(spark, fn.get_field(F.lit(RECORD), field)) == want


def test_set_field(spark):
    def change(field, new):
        return value(spark, fn.set_field(F.lit("a=1|bb=2|c=|"), field, F.lit(new)))

    assert change("bb", "9") == "a=1|bb=9|c="
    assert change("b", "9") == "a=1|bb=2|c="
    assert change("c", "$1\\x") == "a=1|bb=2|c=$1\\x"
    assert change("a", "x,y") == "a=x,y|bb=2|c="


@pytest.mark.parametrize(
    "n, d, want",
    [(29, 200, 0.15), (3, 40, 0.08), (0, 0, 0.0), (1, 3, 0.33), (2, 3, 0.67), (5, 5, 1.0),
     (3, 2, 1.5), (4, 0, 0.0)],
)
def test_ratio(spark, n, d, want):
    assert value(spark, fn.ratio(F.lit(n), F.lit(d))) == want


@pytest.mark.parametrize(
    "n, d, want",
    [(1, 3, "33.33%"), (2, 3, "66.67%"), (1, 1, "100.00%"), (0, 9, "0.00%"), (0, 0, "0.00%"),
     (1, 2000, "0.05%")],
)
def test_percent_text(spark, n, d, want):
    assert value(spark, fn.percent_text(F.lit(n).cast("bigint"), F.lit(d).cast("bigint"))) == want


@pytest.mark.parametrize(
    "x, scale",
    [(0.145, 2), (1.005, 2), (0.125, 2), (0.375, 2), (-0.125, 2), (2.5, 0), (0.25, 1), (1234567.885, 2),
     (0.285, 2), (29.0 / 200, 2), (-1.005, 2), (12.0, 2), (0.1 + 0.2, 3)],
)
def test_format_double_rounds_the_exact_value(spark, x, scale):
    from decimal import ROUND_HALF_UP, Decimal

    want = float(Decimal(x).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP))
    assert value(spark, fn.format_double(F.lit(x), scale)) == want


def test_format_double(spark):
    assert value(spark, fn.format_double(F.lit(1.005).cast("double"), 1)) == 1.0
    assert value(spark, fn.format_double(F.lit(float("nan")), 2)) == 0.0
    assert value(spark, fn.format_double(F.lit(None).cast("double"), 2)) == 0.0


def test_times(spark):
    t = F.lit("2018-12-14 6:20:05")
    parsed = fn.parse_time(t)
    assert value(spark, parsed) == datetime(2018, 12, 14, 6, 20, 5)
    assert value(spark, fn.parse_time(F.lit("soon"))) is None
    assert value(spark, fn.format_time(parsed)) == "2018-12-14 06:20:05"
    assert value(spark, fn.format_date(parsed)) == "2018-12-14"
    assert value(spark, fn.date_hour(parsed)) == "2018-12-14_06"
    assert value(spark, fn.date_key(parsed)) == "20181214"
    assert str(value(spark, fn.parse_date_key(F.lit("20181214")))) == "2018-12-14"
    assert value(spark, fn.time_minute(parsed)) == "201812140620"
    stamp = fn.millis_to_time(F.lit("1545053277205"))
    assert value(spark, fn.format_time(stamp)) == "2018-12-17 13:27:57"


def test_time_order(spark):
    a, b = fn.parse_time(F.lit("2018-12-14 6:20:05")), fn.parse_time(F.lit("2018-12-14 6:21:06"))
    assert value(spark, fn.is_before(a, b)) and not value(spark, fn.is_after(a, b))
    assert value(spark, fn.minus_seconds(b, a)) == 61
    assert value(spark, F.datediff(fn.today(), fn.yesterday())) == 1


def test_json_and_lists(spark):
    assert value(spark, fn.json_int(F.lit('{"product_status": 1}'), "product_status")) == 1
    assert value(spark, fn.json_int(F.lit("{}"), "product_status")) is None
    assert value(spark, fn.json_int(F.lit("broken"), "product_status")) is None
    assert value(spark, fn.split_longs(F.lit("10, 2,,x,3"))) == [10, 2, 3]
    labels = [value(spark, fn.product_status_label(F.lit(s).cast("int"))) for s in (0, 1, None)]
    assert labels == ["自营", "第三方", None]
