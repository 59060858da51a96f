"""Text functions, including access to ``k=v|k=v`` records and JSON fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels of product_status 0 and 1.
SELF_RUN = "自营"
THIRD_PARTY = "第三方"


def is_empty(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0)) == 0


def is_not_empty(s: Column) -> Column:
    return ~is_empty(s)


def trim_comma(s: Column) -> Column:
    """Drop one comma at each end."""
    return F.regexp_replace(s, "^,|,$", "")


def pad_two(s: Column) -> Column:
    """Prefix ``0`` unless the text already has two characters."""
    return F.when(F.length(s) == 2, s).otherwise(F.concat(F.lit("0"), s))


def get_field(record: Column, field: str) -> Column:
    """Value of ``field`` in ``k=v|k=v`` text; NULL when absent or empty."""
    pattern = rf"(?:^|\|){re.escape(field)}=([^|=]+)(?=\||$)"
    return F.nullif(F.regexp_extract(record, pattern, 1), F.lit(""))


def set_field(record: Column, field: str, value: Column) -> Column:
    """Replace the value of an existing ``field``; a missing field changes nothing."""
    body = F.regexp_replace(record, r"\|+$", "")
    quoted = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
    pattern = rf"(^|\|){re.escape(field)}(?:=[^|]*)?(?=\||$)"
    return F.regexp_replace(body, F.lit(pattern), F.concat(F.lit(f"$1{field}="), quoted))


def split_longs(s: Column) -> Column:
    """Comma list to ``array<bigint>``; tokens that are no numbers are dropped."""
    numbers = F.transform(F.split(s, ","), lambda t: F.trim(t).try_cast("bigint"))
    return F.filter(numbers, lambda n: n.isNotNull())


def json_int(s: Column, field: str) -> Column:
    """Integer at a top-level JSON field; NULL when absent or malformed."""
    return F.get_json_object(s, f"$.{field}").try_cast("int")


def product_status_label(status: Column) -> Column:
    return F.when(status == 0, F.lit(SELF_RUN)).when(status.isNotNull(), F.lit(THIRD_PARTY))
