"""Token-id files of independent zstandard frames.

A file holds frames of at most ``FRAME`` ids, then a skippable frame with the
documents of the file, then a seek table in the public seekable layout: sizes and
a checksum of each frame.  A reader fetches the tail of a file and after that only
the frames that hold what it was asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicktide.llm.common import open_folder, stored, texts, write_file
from clicktide.llm.tokens import byte_bpe, encoded
from clicktide.session import scratch_dir

FRAME = 1 << 16  # ids
FILE = 1 << 27  # ids after which a task begins another file
END = 0
# Fixed values of the seekable layout.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def _skippable(payload: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(payload)) + payload


def file_chunks(docs: Iterable[tuple[int | None, bytes]], count: list, frame: int = FRAME) -> Iterator[bytes]:
    """Bytes of a file of ``docs`` (id and ids as bytes); ``count`` gets documents and ids.

    What is held is a frame, and a few bytes per document and frame.
    """
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    ids, known, sizes, table = [], [], [], []
    held = bytearray()

    def closed(raw: bytes) -> bytes:
        body = packer.compress(raw)
        table.append((len(body), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return body

    for doc, raw in docs:
        ids.append(0 if doc is None else doc)
        known.append(doc is not None)
        sizes.append(len(raw) // 4)
        held += raw
        while len(held) >= 4 * frame:
            yield closed(bytes(held[: 4 * frame]))
            del held[: 4 * frame]
    if held:
        yield closed(bytes(held))
    index = np.array(ids, "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + np.array(known, "u1").tobytes()
    body = packer.compress(index)
    yield _skippable(body)
    entries = b"".join(struct.pack("<III", *e) for e in table)
    # the length of the document list stands before the entries of the seek table
    foot = struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEKABLE)
    yield struct.pack("<IIQQ", SKIPPABLE, 16, len(body), len(ids))
    yield _skippable(entries + foot)
    count += [len(ids), sum(sizes)]


class Reader:
    """Documents of one file, by position or id."""

    def __init__(self, fs, path: str) -> None:
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        begin = end - 9 - 12 * n
        self.table = np.frombuffer(self.file.read_at(12 * n, begin), "<u4").reshape(n, 3)
        at = begin - 8 - 16
        packed, docs = struct.unpack("<QQ", self.file.read_at(16, at))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at - 8 - packed))
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.sizes = np.frombuffer(raw, "<i8", docs, 8 * docs)
        self.known = np.frombuffer(raw, "u1", docs, 16 * docs).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        self.raw_at = np.concatenate(([0], np.cumsum(self.table[:, 1].astype(np.int64))))
        self.frames_read = 0
        self._last = (-1, b"")

    def frame(self, i: int) -> bytes:
        """A frame, checked; the last one read is kept."""
        if self._last[0] != i:
            raw = zstandard.ZstdDecompressor().decompress(
                self.file.read_at(int(self.at[i + 1] - self.at[i]), int(self.at[i]))
            )
            if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i} is damaged")
            self._last = (i, raw)
            self.frames_read += 1
        return self._last[1]

    def document(self, i: int) -> bytes:
        """Ids of the document at position ``i``, four bytes each."""
        low, high = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        parts = []
        k = int(np.searchsorted(self.raw_at, low, "right")) - 1
        while low < high:
            base = int(self.raw_at[k])
            stop = min(high, int(self.raw_at[k + 1]))
            parts.append(self.frame(k)[low - base : stop - base])
            low, k = stop, k + 1
        return b"".join(parts)

    def documents(self, ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """Id, start in the file and ids of all documents, or of those asked for."""
        wanted = range(len(self.ids))
        if ids is not None:
            wanted = np.flatnonzero(np.isin(self.ids, np.array(list(ids), "<i8")) & self.known).tolist()
        for i in wanted:
            yield int(self.ids[i]) if self.known[i] else None, int(self.starts[i]), self.document(i)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, frame: int = FRAME, file: int = FILE
) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the list of files.

    A file holds a range of ids, and ends with the document that brings it to
    ``file`` ids or more.  The rows returned are ``part`` and ``seq`` (order of the
    files), ``name``, ``n_docs`` and ``n_tokens``.  A document is the ids of its
    text, then ``end``; a null or empty text is ``end`` alone.  Rows with equal
    ids are ordered by a hash of their text, a null id comes first, other columns are
    ignored; an empty table gives no file.
    """
    path = tokenizer or byte_bpe()
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        rows = ((doc, ids + last) for doc, ids in encoded(batches, path))
        following = next(rows, None)

        def one_file() -> Iterator[tuple[int | None, bytes]]:
            nonlocal following
            held = 0
            while following is not None and held < 4 * file:
                held += len(following[1])
                yield following
                following = next(rows, None)

        while following is not None:
            count: list[int] = []
            name = write_file(folder, f"part-{part:06d}-{seq:06d}", ".tok.zst", file_chunks(one_file(), count, frame))
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "name": [name], "n_docs": [count[0]], "n_tokens": [count[1]]}
            )
            seq += 1

    order = ["doc_id", F.xxhash64("text")]
    sorted_docs = texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    # stored, so that a file is named once, by the task that Spark has accepted
    listed = sorted_docs.mapInArrow(run, "part bigint, seq bigint, name string, n_docs bigint, n_tokens bigint")
    return stored(listed, "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it.  A task reads one file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    listed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc, start, raw in Reader(fs, f"{root}/{name}").documents():
                    rows.append((doc, base + start, len(raw) // 4, zlib.crc32(raw)))
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return (
        listed.select("name", "base").repartition(parts, "name")
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def token_files(docs: DataFrame) -> DataFrame:
    """Write to a new shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder))
