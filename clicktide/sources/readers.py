"""Batch and stream readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.sources import schemas


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One input table stored as parquet below ``base``, with its declared schema.

    ``user_visit_action`` is expected to be partitioned by ``date`` at scale
    (see :func:`clicktide.sources.tables.write_actions`).
    """
    return spark.read.schema(schemas.INPUT_TABLES[name]).parquet(f"{base.rstrip('/')}/{name}")


def action_date_range(
    actions: DataFrame,
    start: str | None = None,
    end: str | None = None,
    date_col: str = "date",
) -> DataFrame:
    """Rows whose date lies in ``[start, end]``; a missing bound does not restrict.

    On a table partitioned by ``date`` the predicate prunes partitions.
    """
    col = F.col(date_col)
    if start is not None:
        actions = actions.where(col >= F.lit(start).cast("date"))
    if end is not None:
        actions = actions.where(col <= F.lit(end).cast("date"))
    return actions


def time_in_dates(time_col: str, start: str | None, end: str | None, dtype: str = "timestamp_ntz"):
    """The same range as a predicate on the raw time column, which parquet can skip by."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(time_col) >= F.lit(start).cast("date").cast(dtype))
    if end is not None:
        cond = cond & (F.col(time_col) < F.date_add(F.lit(end).cast("date"), 1).cast(dtype))
    return cond


def read_session_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines written by :func:`clicktide.sources.tables.write_session_text`."""
    return spark.read.text(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 16,
) -> DataFrame:
    """A JDBC table; with a numeric ``partition_column`` the read is split into ranges."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=dict(properties))
    if bounds is None:
        raise ValueError("a partitioned JDBC read needs bounds")
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=num_partitions, properties=dict(properties),
    )


def read_kafka_lines(
    spark: SparkSession, servers: str, topic: str, **options: str
) -> DataFrame:
    """Stream of message texts from Kafka, as a ``value`` column."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of text lines from files arriving in ``path``."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
