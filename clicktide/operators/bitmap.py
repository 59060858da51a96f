"""A bitmap of hashed ids: who may be on a list, in a fixed number of bytes.

An id that is not marked is on no list; a marked one may be another's hash, so an
exact look-up comes behind.  The bitmap is a table of 4 KB slices, ``slice`` and
``bits``, at most ``SIZE / 8`` bytes whatever the length of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 23  # bits: 1 MB
SCHEMA = "slice bigint, bits binary"


def _number(ids: Column, size: int) -> Column:
    # numbered from 1, as the slices count
    return F.pmod(F.xxhash64(ids), F.lit(size)) + 1


def marked(ids: DataFrame, size: int = SIZE) -> DataFrame:
    """The bitmap of a one-column frame."""
    number = _number(F.col(ids.columns[0]), size)
    return ids.select(F.bitmap_bucket_number(number).alias("slice"), F.bitmap_bit_position(number).alias("at")).groupBy(
        "slice").agg(F.bitmap_construct_agg("at").alias("bits"))


def joined(one: DataFrame, other: DataFrame) -> DataFrame:
    """Bitmap of all ids of two."""
    return one.unionByName(other).groupBy("slice").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_in(ids: DataFrame, bits: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of a one-column frame whose bit is set."""
    name = ids.columns[0]
    number = _number(F.col(name), size)
    placed = ids.select(name, F.bitmap_bucket_number(number).alias("slice"), F.bitmap_bit_position(number).alias("at"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(at % 8 as int)) & 1") == 1
    # at most SIZE / 8 bytes
    return placed.join(F.broadcast(bits), "slice").withColumn("byte", byte).where(is_set).select(name)
