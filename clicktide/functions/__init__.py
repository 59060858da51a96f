"""Scalar functions: each returns a ``Column`` built from Spark built-ins."""

from clicktide.functions.dates import (
    date_hour,
    date_key,
    format_date,
    format_time,
    is_after,
    is_before,
    millis_to_time,
    minus_seconds,
    parse_date_key,
    parse_time,
    time_minute,
    today,
    visit_millis,
    yesterday,
)
from clicktide.functions.numbers import div, format_double, percent_text, ratio, rounded_share
from clicktide.functions.text import (
    get_field,
    is_empty,
    is_not_empty,
    json_int,
    pad_two,
    product_status_label,
    set_field,
    split_longs,
    trim_comma,
)

__all__ = [
    "date_hour", "date_key", "div", "format_date", "format_double", "format_time", "get_field",
    "is_after", "is_before", "is_empty", "is_not_empty", "json_int", "millis_to_time",
    "minus_seconds", "pad_two", "parse_date_key", "parse_time", "percent_text",
    "product_status_label", "ratio", "rounded_share", "set_field", "split_longs",
    "time_minute", "today", "trim_comma", "visit_millis", "yesterday",
]
