"""Table sinks: append, upsert, replace-group and insert-if-absent on parquet.

A table that changes is a log of versions.  A writer adds the changed rows under
its own ``version`` partition, so the cost follows the batch and not the table,
and a repeated write of one version replaces itself.  A reader keeps the newest
row of each key, or the newest rows of each group.  ``compact`` folds old
versions into one.

Batch ``i`` of a stream writes version ``2 * i``; compaction up to batch ``i``
writes ``2 * i + 1``, which ranks above everything it folds and below all later
batches, so stopping half-way through a compaction loses nothing, and folded
versions that are still there change no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktide.session import scratch_dir
from clicktide.sources import schemas

VERSION = "version"


def batch_version(batch_id: int) -> int:
    return 2 * batch_id


# --- file system ----------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def ensure_table(spark: SparkSession, path: str) -> str:
    """Create the folder of a table that may be read before its first write."""
    fs, jpath = _fs(spark, path)
    fs.mkdirs(jpath)
    return path


def publish_once(df: DataFrame, staging: str, target: str) -> bool:
    """Write ``df`` beside ``target`` and rename it into place, once.

    Readers see the whole folder or nothing, and a repeat changes nothing.
    The rename is atomic on HDFS and local disks.
    """
    spark = df.sparkSession
    if path_exists(spark, target):
        return False
    df.write.mode("overwrite").parquet(staging)
    fs, source = _fs(spark, staging)
    _, dest = _fs(spark, target)
    fs.mkdirs(dest.getParent())
    if not fs.rename(source, dest):
        raise OSError(f"cannot publish {target}")
    return True


def materialize(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder, or below ``base``, for use by several plans.

    Unlike cached blocks the files outlive the executors that wrote them.
    """
    path = f"{base}/{name}" if base else scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose tables are no longer needed."""
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def write_mark(spark: SparkSession, path: str, text: str = "") -> None:
    """Put a small file in place, whole or not at all; one that is there stays."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return
    _, fresh = _fs(spark, f"{path}.new")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(fresh, target):
        raise OSError(f"cannot write {path}")


def read_mark(spark: SparkSession, path: str) -> str | None:
    """Text of a mark; None if there is none."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


# --- append ---------------------------------------------------------------

def result_rows(df: DataFrame, table: str, task_id: int) -> DataFrame:
    """``df`` with the task id, cut to the columns of a result table."""
    return df.withColumn("task_id", F.lit(task_id).cast("bigint")).select(
        *schemas.RESULT_COLUMNS[table]
    )


def append_result(df: DataFrame, base: str, table: str, task_id: int) -> None:
    """Append the rows of one task to a result table."""
    result_rows(df, table, task_id).write.mode("append").parquet(f"{base.rstrip('/')}/{table}")


def append_jdbc(
    df: DataFrame, url: str, table: str, task_id: int, properties: Mapping[str, str]
) -> None:
    """The same append into a database table."""
    result_rows(df, table, task_id).write.jdbc(
        url, table, mode="append", properties=dict(properties)
    )


def write_actions(actions: DataFrame, path: str) -> None:
    """Store the click log partitioned by date, so that date ranges prune folders."""
    actions.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)


def write_session_text(lines: DataFrame, path: str) -> None:
    """Store encoded session records as text lines."""
    lines.select("value").write.mode("overwrite").text(path)


# --- versions -------------------------------------------------------------

def write_version(df: DataFrame, path: str, version: int, partition_by: Sequence[str] = ()) -> None:
    """Write the changed rows of a table as one version."""
    (
        df.withColumn(VERSION, F.lit(version).cast("bigint"))
        .hint("rebalance", *partition_by)  # few files, and a large partition split over tasks
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by, VERSION)
        .parquet(path)
    )


def read_versions(
    spark: SparkSession, path: str, schema: T.StructType, folders: Iterable[str] | None = None
) -> DataFrame:
    """All rows of a table with their versions; with ``folders`` (``date=2024-01-05``) only
    those partitions are listed, however many there are."""
    full = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
    reader = spark.read.schema(full)
    if folders is None:
        return reader.parquet(path)
    there = [f"{path}/{f}" for f in folders if path_exists(spark, f"{path}/{f}")]
    return reader.option("basePath", path).parquet(*there) if there else spark.createDataFrame([], full)


def _newest_rows(rows: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    values = [f.name for f in schema.fields if f.name not in keys]
    if not values:
        return rows.select(*keys).distinct()
    if len(values) == 1:  # one plain value aggregates by hash, a struct only by sort
        newest = rows.groupBy(*keys).agg(F.max_by(values[0], VERSION).alias(values[0]))
    else:
        picked = F.max_by(F.struct(*values), VERSION).alias("row")
        newest = rows.groupBy(*keys).agg(picked).select(*keys, "row.*")
    return newest.select(*schema.fieldNames())


def _newest_groups(rows: DataFrame, schema: T.StructType, group: Sequence[str]) -> DataFrame:
    newest = rows.groupBy(*group).agg(F.max(VERSION).alias(VERSION))
    return rows.join(newest, [*group, VERSION], "left_semi").select(*schema.fieldNames())


def read_upserted(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
    folders: Iterable[str] | None = None, before: int | None = None,
) -> DataFrame:
    """Current rows of a table whose versions add or overwrite rows by key, in some partitions or by
    the versions ``before`` one."""
    rows = read_versions(spark, path, schema, folders)
    return _newest_rows(rows if before is None else rows.where(F.col(VERSION) < before), schema, keys)


def read_replaced(
    spark: SparkSession, path: str, schema: T.StructType, group: Sequence[str]
) -> DataFrame:
    """Current rows of a table whose versions replace every group they hold."""
    return _newest_groups(read_versions(spark, path, schema), schema, group)


def compact(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    batch_id: int,
    partition_by: Sequence[str] = (),
    where: Column | None = None,
    groups: bool = False,
    only: Iterable[object] | None = None,
    folded_before: Iterable[object] = (),
) -> None:
    """Fold the versions up to a finished ``batch_id`` into one, in the partitions
    ``where`` selects.  With ``groups`` the keys name the groups that versions replace.

    ``only`` names the values of the partition column that were written since the last
    compaction, and ``folded_before`` those that it folded: no other folder is looked at.
    The folded versions are dropped by the next compaction only, so that
    readers which have listed them can finish.
    """
    depth = len(partition_by)
    names = None if only is None else [f"{partition_by[0]}={v}" for v in only]
    known = _version_folders(spark, path, depth, names)
    folders = [(v, f) for v, f in known if v <= batch_version(batch_id)]
    if folders:
        base = max(v for v, _ in folders) // 2 * 2 + 1
        old = read_versions(spark, path, schema).where(F.col(VERSION) < base)
        if where is not None:
            old = old.where(where)
        values = [None]
        if depth == 1:  # what has one version alone needs no folding
            last: dict[str, int] = {}
            named = [(f.getParent().getName().split("=", 1)[1], v) for v, f in folders]
            for name, v in named:
                last[name] = max(last.get(name, -1), v if v % 2 else -1)
            several = Counter(name for name, v in named if v >= last[name])
            values = [name for name, n in several.items() if n > 1]
            old = old.where(F.col(partition_by[0]).cast("string").isin(values))
        if values:
            newest = _newest_groups if groups else _newest_rows
            write_version(newest(old, schema, keys), path, base, partition_by)
    if names is not None:
        names = sorted({*names, *(f"{partition_by[0]}={v}" for v in folded_before)})
    _drop_folded(spark, path, batch_version(batch_id), depth, names)


def _version_folders(
    spark: SparkSession, path: str, depth: int, names: Sequence[str] | None = None
) -> list[tuple[int, object]]:
    """Versions with their folders, in the partitions ``names`` if given."""
    found = []
    for middle in ["/*" * depth] if names is None else [f"/{n}" for n in names]:
        fs, pattern = _fs(spark, f"{path}{middle}/{VERSION}=*")
        found += [status.getPath() for status in fs.globStatus(pattern) or []]
    return [(int(folder.getName().split("=")[1]), folder) for folder in found]


def _drop_folded(spark: SparkSession, path: str, upto: int, depth: int, names: Sequence[str] | None) -> None:
    """Delete what the compaction before the one up to ``upto`` has folded."""
    fs, _ = _fs(spark, path)
    partitions: dict[str, list[tuple[int, object]]] = {}
    for version, folder in _version_folders(spark, path, depth, names):
        partitions.setdefault(folder.getParent().toString(), []).append((version, folder))
    for entries in partitions.values():
        # a base written by this compaction still has its versions beside it
        previous = max((v for v, _ in entries if v % 2 == 1 and v < upto), default=0)
        for version, folder in entries:
            if version < previous:
                fs.delete(folder, True)


# --- insert if absent -----------------------------------------------------

BUCKET = "bucket"
BUCKETS = 16


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucketed(schema: T.StructType) -> T.StructType:
    """Schema of the rows of an insert-if-absent table as they are stored."""
    return T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])


def touched_buckets(keyed: DataFrame) -> list[int]:
    """The buckets of some rows: a list no longer than the number of buckets."""
    return sorted(keyed.agg(F.collect_set(BUCKET)).first()[0])


def stored_in_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int]) -> DataFrame:
    """Rows of an insert-if-absent table in some of its buckets, with their versions."""
    return read_versions(spark, path, bucketed(schema), [f"{BUCKET}={b}" for b in buckets])


def insert_absent(
    df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], version: int, buckets: int = BUCKETS
) -> list[int]:
    """Insert the keys that no other version holds, as one version; returns the buckets looked at.

    The table is laid out in ``buckets`` folders by hash of the keys, and only the
    buckets of the new keys are read.  The number of buckets stays that of the first insert.
    """
    spark = df.sparkSession
    keyed = df.select(*keys).distinct().withColumn(BUCKET, bucket_of(keys, buckets))
    touched = touched_buckets(keyed)
    if touched:
        others = stored_in_buckets(spark, path, schema, touched).where(F.col(VERSION) != version)
        fresh = keyed.join(others.select(*keys, BUCKET), [*keys, BUCKET], "left_anti")
        write_version(fresh, path, version, [BUCKET])
    return touched


def read_inserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Distinct rows of an insert-if-absent table."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames()).distinct()
