"""Shared tables and files of the operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import clicktide
from clicktide.session import scratch_dir


SLICE = 1 << 21  # bytes of text that array code takes at a time
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once per application, wherever they run.

    Batches of whole texts are held several times over, in the JVM and in Python, so
    they are kept just below a slice unless the application was given a size.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(SLICE * 7 // 8))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(clicktide.__file__).parent
        path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"  # Spark serves it from here
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (bigint) and ``text`` (string) alone, so that no other column can clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *more,
    )


def bucket_of(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, local or remote."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(folder: str, stem: str, suffix: str, chunks: Iterator[bytes]) -> str:
    """Write a file under a name of its own, so that a repeated task never meets its first try."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of text; a longer text is one slice."""
    arr = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(arr), 0).to_pylist()
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield batch.slice(low)
