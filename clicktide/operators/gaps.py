"""Sessions cut from a user's log at gaps of silence.

The log is range-partitioned by user and time, so a user with a large part of it
is spread over several partitions.  Gaps are found inside the partitions; what a
user's rows in one partition have to know of those before is their last time and
how many sessions began, and that comes from one row per user and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.operators.ranged import PART, PLACE, stored_in_order

GAP_SECONDS = 6 * 3600


def _silent(earlier: Column, later: Column, gap_seconds: float) -> Column:
    """More than the gap between two times; a missing time is silent to a time, not to another missing one."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.when(earlier.isNull() & later.isNull(), F.lit(False)).otherwise(
        F.coalesce(micros > F.lit(int(gap_seconds * 1_000_000)), F.lit(True)))


def number_sessions(
    log: DataFrame, gap_seconds: float = GAP_SECONDS, user: str = "user_id", time: str = "action_time",
    tie: str | None = None,
) -> DataFrame:
    """``log`` with ``session_no``: 1 for a user's first rows, one more after every longer gap.

    A gap of exactly ``gap_seconds`` does not part.  Rows of one instant are in one
    session, whatever their order by ``tie``.  Rows without a time come first and are a session
    of their own; rows without a user are those of one unknown user.
    """
    columns = log.columns
    rows = stored_in_order(log, user, time, *([tie] if tie else []), name="gap-order")
    # a hot user's rows are as many groups as it has partitions
    inside = Window.partitionBy(PART, user).orderBy(PLACE)
    before = F.lag(F.struct(time)).over(inside)
    begins = F.when(before.isNull(), F.lit(0)).otherwise(_silent(before[time], F.col(time), gap_seconds).cast("int"))
    marked = rows.withColumn("gap_begins", begins)

    ends = marked.groupBy(F.col(PART).alias("gap_part"), F.col(user).alias("gap_user")).agg(
        F.min_by(time, PLACE).alias("head"), F.max_by(time, PLACE).alias("tail"), F.sum("gap_begins").alias("begun"),
    )
    in_turn = Window.partitionBy("gap_user").orderBy("gap_part")
    tail = F.lag(F.struct("tail")).over(in_turn)
    head_begins = F.when(tail.isNull(), F.lit(1)).otherwise(_silent(tail["tail"], F.col("head"), gap_seconds).cast("int"))
    counted = ends.withColumn("own", head_begins)
    # sessions begun up to the head of these rows
    carried = counted.select(
        "gap_part", "gap_user",
        (F.sum(F.col("own") + F.col("begun")).over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("begun")).alias("carried"),
    )
    running = F.sum("gap_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.select(*columns, PART, running.alias("running"))
    same = (F.col(PART) == F.col("gap_part")) & F.col(user).eqNullSafe(F.col("gap_user"))
    return numbered.join(carried, same).select(
        *columns, (F.col("carried") + F.col("running")).cast("bigint").alias("session_no"))


def cut_at_gaps(
    actions: DataFrame, gap_seconds: float = GAP_SECONDS, tie: str | None = None
) -> DataFrame:
    """Actions with ``session_id`` from their user and the number of the session: ``7-3``."""
    numbered = number_sessions(actions.drop("session_id"), gap_seconds, tie=tie)
    made = F.concat_ws("-", F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.col("session_no").cast("string"))
    return numbered.withColumn("session_id", made).select(*actions.columns)
