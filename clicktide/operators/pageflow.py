"""Page-flow steps and one-step conversion rates.

A session may hold a large part of the log, so the previous page of an action
is not looked up over whole sessions.  The log is range-partitioned by session and
time; one window finds the pairs inside the partitions, and the last row of a
partition is carried over to the first of the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.functions import ratio
from clicktide.operators.ranged import PART, PLACE, in_order, stored_in_order

ORDER = ("session_id", "action_time", "page_id")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows of a range order with the page before each in its session and partition.

    ``first`` and ``last`` tell the ends of a session's rows in a partition.
    """
    inside = Window.partitionBy(PART, "session_id").orderBy(PLACE)
    # the structs tell a missing neighbour from one without a page
    before = F.lag(F.struct("page_id")).over(inside)
    after = F.lead(F.struct("page_id")).over(inside)
    found = rows.select("session_id", "page_id", PART, PLACE, before.alias("before"), after.alias("after"))
    return found.select(
        "session_id", "page_id", PART, PLACE, F.col("before.page_id").alias("prev_page"),
        F.col("before").isNull().alias("first"), F.col("after").isNull().alias("last"),
    )


def _edges(first: Column, last: Column) -> Column:
    """Which ends of its partition a row may be: a partition's last row ends its session there."""
    return F.array_compact(F.array(F.when(first & (F.col(PLACE) == 0), F.lit(0)), F.when(last, F.lit(1))))


def _carried() -> Column:
    """The page carried over to the first row of a partition, from edges of all partitions.

    NULL if the session begins there; a struct, as a page may be NULL too.
    """
    # two rows per partition
    row = F.lag("row").over(Window.partitionBy("edges").orderBy(PART, "edge"))
    same = row["session_id"].eqNullSafe(F.col("row.session_id"))
    return F.when((F.col("edge") == 0) & same, F.struct(row["page_id"].alias("page_id")))


def previous_pages(actions: DataFrame) -> DataFrame:
    """``session_id, prev_page, page_id`` for every action in time order.

    ``prev_page`` is NULL for the first action of a session and after an action
    without a page.  Actions at one instant are ordered by page.
    """
    rows = _neighbours(stored_in_order(actions.select(*ORDER), *ORDER, name="page-order"))
    ends = rows.select(PART, PLACE, "session_id", "page_id", F.explode(_edges(F.col("first"), F.col("last"))).alias("edge"))
    kept = ends.groupBy(PART, "edge").agg(F.max_by(F.struct("session_id", "page_id"), PLACE).alias("row"))
    carried = kept.withColumn("edges", F.lit(0)).select(F.col(PART).alias("to"), "edge", _carried().alias("carried"))
    heads = carried.where("edge = 0").select("to", "carried")
    # a row per partition on the right
    linked = rows.join(heads, (F.col(PART) == F.col("to")) & (F.col(PLACE) == 0), "left")
    return linked.select("session_id", F.coalesce("prev_page", "carried.page_id").alias("prev_page"), "page_id")


def _counted(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """``label, pv`` of the wanted steps and of the visits to the start page, in one pass."""
    rows = _neighbours(in_order(actions.select(*ORDER), *ORDER))
    step = _step(F.col("prev_page"), F.col("page_id"))
    nowhere = F.lit(None).cast("bigint")

    def event(label: Column, part: Column, edge: Column) -> Column:
        return F.struct(label.cast("string").alias("label"), part.cast("bigint").alias(PART), edge.cast("int").alias("edge"))

    edges = F.transform(_edges(F.col("first"), F.col("last")), lambda e: event(F.lit(None), F.col(PART), e))
    labels = F.array_compact(F.array(
        F.when(~F.col("first") & step.isin(flow_steps(flow)), step), F.when(F.col("page_id") == F.lit(int(flow[0])), F.lit(START)),
    ))
    events = F.concat(edges, F.transform(labels, lambda x: event(x, nowhere, nowhere)))
    # one row per label and two per partition are left, before the shuffle already
    told = (
        rows.select("session_id", "page_id", F.col(PLACE).alias("place"), F.inline(events))
        .groupBy("label", PART, "edge")
        .agg(F.count(F.lit(1)).alias("pv"), F.max_by(F.struct("session_id", "page_id"), "place").alias("row"))
        .withColumn("edges", F.col("label").isNull())
    )
    link = F.when(F.col("edges"), _step(_carried()["page_id"], F.col("row.page_id")))
    labelled = told.select(F.coalesce("label", link).alias("label"), F.when(F.col("edges"), F.lit(1)).otherwise(F.col("pv")).alias("pv"))
    return (
        labelled.where(F.col("label").isin([START, *flow_steps(flow)]))
        .groupBy("label").agg(F.sum("pv").alias("pv"))
    )


# Label of a visit to the start page; no step looks like it.
START = "start"


def _step(prev: Column, page: Column) -> Column:
    # NULL unless both pages are there
    return F.concat(prev.cast("string"), F.lit("_"), page.cast("string"))


def flow_steps(flow: Sequence[int]) -> list[str]:
    """Consecutive pairs of the target flow as ``1_2`` labels."""
    return [f"{a}_{b}" for a, b in zip(flow, flow[1:])]


def page_split_counts(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """How often each step of the flow occurs between adjacent actions of a session."""
    counted = _counted(actions, flow).where(F.col("label") != START)
    return counted.select(F.col("label").alias("page_split"), "pv")


def start_page_visits(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """Number of visits to the first page of the flow."""
    start = actions.where(F.col("page_id") == F.lit(int(flow[0])))
    return start.agg(F.count(F.lit(1)).alias("start_page_visits"))


def page_convert_rate(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """``step_no, page_split, pv, convert_rate`` for every step of the flow.

    The first step is measured against visits of the start page, each later one
    against the step before.  Start visits and step counts come from one pass.
    """
    labels = flow_steps(flow)
    counted = _counted(actions, flow)
    spark = actions.sparkSession
    wanted = spark.range(1).select(
        F.lit(",".join(map(str, flow))).alias("flow"),
        F.posexplode(F.array(*[F.lit(x) for x in [START, *labels]])).alias("step_no", "label"),
    )
    # one window partition per flow, as many rows as the flow has pages
    in_order = Window.partitionBy("flow").orderBy("step_no")
    pv = F.coalesce("pv", F.lit(0).cast("bigint"))
    rows = wanted.join(counted, "label", "left").select("flow", "step_no", "label", pv.alias("pv"))
    rated = rows.select(
        "step_no",
        F.col("label").alias("page_split"),
        "pv",
        F.when(F.first("pv").over(in_order) == 0, F.lit(0.0))
        .otherwise(ratio(F.col("pv"), F.lag("pv").over(in_order)))
        .alias("convert_rate"),
    )
    return rated.where(F.col("step_no") > 0)


def convert_rate_text(rates: DataFrame) -> DataFrame:
    """Rates as ``1_2=0.88`` texts."""
    return rates.select(
        F.concat_ws("=", "page_split", F.col("convert_rate").cast("string")).alias("convert_rate")
    )
