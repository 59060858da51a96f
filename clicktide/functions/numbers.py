"""Ratios and rounding.

Ratios are rounded half-up from the integer pair, never from a binary double,
so the same numbers come out of any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _half_up(n: Column, d: Column, scale: int) -> Column:
    # floor(n * scale / d + 1/2) on integers; d > 0
    return div(n * F.lit(2 * scale) + d, d * F.lit(2))


def ratio(n: Column, d: Column) -> Column:
    """``n / d`` to two decimals, half-up; 0 when ``d`` is 0 or NULL."""
    return F.when(d > 0, _half_up(n, d, 100).cast("double") / F.lit(100.0)).otherwise(F.lit(0.0))


def percent_text(n: Column, d: Column) -> Column:
    """``n`` as a percentage of ``d`` in the form ``12.34%``; ``0.00%`` when ``d`` is 0."""
    hundredths = F.when(d > 0, _half_up(n, d, 10000)).otherwise(F.lit(0).cast("bigint"))
    cents = F.lpad(F.pmod(hundredths, F.lit(100)).cast("string"), 2, "0")
    return F.concat(div(hundredths, 100).cast("string"), F.lit("."), cents, F.lit("%"))


def rounded_share(n: Column, d: Column, total: int) -> Column:
    """``n / d`` of ``total``, rounded half-up to a whole number."""
    return F.when(d > 0, _half_up(n, d, total)).otherwise(F.lit(0).cast("bigint"))


def format_double(x: Column, scale: int) -> Column:
    """Half-up rounding of the exact value of a double to ``scale`` places; NaN and NULL become 0.

    A double lies exactly between two such values only if it is an odd multiple of
    ``2 ** -(scale + 1)``; anything else is rounded by its exact binary value.
    """
    halves = x * F.lit(float(2 ** (scale + 1)))
    tie = (halves == F.floor(halves)) & (F.abs(halves % F.lit(2.0)) == 1.0)
    nearest = F.regexp_replace(F.format_number(x, scale), ",", "").cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    return F.when(known, F.when(tie, F.round(x, scale)).otherwise(nearest)).otherwise(F.lit(0.0))
