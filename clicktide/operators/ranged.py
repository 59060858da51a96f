"""Rows in one order over range partitions: places, positions in groups, neighbours.

A group may hold a large part of a table, so it is never ordered as a whole in one
task.  The table is range-partitioned by group and order; Spark samples the
bounds, so a hot group is spread over as many partitions as its rows fill.  What
a partition cannot know, the rows before it, is carried over through one row per
partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.sources.tables import materialize

PART, PLACE, READ = "range_part", "range_place", "range_read"
# monotonically_increasing_id: partition above, place in it below
_BITS = 33


def in_order(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions by ``order``, each with its number and its rows' places from 0.

    Rows that are equal in ``order`` follow each other as they were read, and may
    lie in two partitions.  Store the result before it is used twice: another
    computation samples other bounds.  The driver gets some 300 rows per partition
    for the bounds; without ``partitions`` there are as many as shuffles have.
    """
    read = df.withColumn(READ, F.monotonically_increasing_id())
    number = () if partitions is None else (partitions,)
    placed = read.repartitionByRange(*number, *order, READ).sortWithinPartitions(*order, READ).drop(READ)
    at = F.monotonically_increasing_id()
    return placed.select(
        "*", F.shiftright(at, _BITS).alias(PART), at.bitwiseAND(F.lit((1 << _BITS) - 1)).alias(PLACE)
    )


def stored_in_order(
    df: DataFrame, *order: str | Column, name: str = "ordered", partitions: int | None = None,
) -> DataFrame:
    """:func:`in_order`, written to the shared folder and read again."""
    return materialize(in_order(df, *order, partitions=partitions), name)


def runs(rows: DataFrame, group: str | None = None) -> DataFrame:
    """One row per partition and group of a stored order whose leading key is ``group``.

    ``run_shift`` plus a row's place is its position in the group, from 0, and
    ``members`` the size of the group; ``run_part`` and ``run_group`` name the run.
    Without ``group`` the whole table is one.
    """
    keyed = rows.select(F.col(PART).alias("run_part"), (F.col(group) if group else F.lit(0)).alias("run_group"), PLACE)
    counted = keyed.groupBy("run_part", "run_group").agg(F.min(PLACE).alias("head"), F.count(F.lit(1)).alias("n"))
    # as many rows in a window as the group has partitions
    whole = Window.partitionBy("run_group")
    before = F.sum("n").over(whole.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0).cast("bigint")) - F.col("head")
    return counted.select("run_part", "run_group", shift.alias("run_shift"), F.sum("n").over(whole).alias("members"))


def same_run(group: str | None = None) -> Column:
    """Condition that joins a stored order to its runs."""
    here = F.col(PART) == F.col("run_part")
    return here & F.col(group).eqNullSafe(F.col("run_group")) if group else here


def positions(rows: DataFrame, group: str | None = None) -> DataFrame:
    """A stored order with each row's ``position`` in its group and the group's ``members``."""
    columns = [c for c in rows.columns if c not in (PART, PLACE)]
    position = F.col(PLACE) + F.col("run_shift")
    return rows.join(runs(rows, group), same_run(group)).select(*columns, position.alias("position"), "members")
