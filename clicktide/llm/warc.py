"""Deduplicated WARC archives with revisit records.

Headers alone are shuffled by payload digest: the smallest ``page_id`` of a digest
becomes the response, the others become revisits that name it.  Readers resolve
a revisit by the digest and id of its response.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import open_folder, stored, write_file
from clicktide.session import scratch_dir

LEAST_BYTES = 100  # smaller payloads are always stored
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``digest``, ``n_bytes`` and ``refers_to`` of each page, without payloads.

    The digest is SHA-256 in lower-case hex of the UTF-8 payload, null being
    empty.  Among payloads of at least ``least`` bytes with one digest, the
    smallest ``page_id`` has a null ``refers_to``, and so have all its repeated
    rows; the rest refer to it.  A page without an id refers to nothing.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    headers = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("n_bytes"),
    )
    # a digest is summed up before the shuffle, so a frequent payload moves one row per task
    firsts = headers.where(F.col("n_bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("original"), F.min_by("url", "page_id").alias("original_url"),
        F.count("*").alias("n"),
    ).where("n > 1").drop("n")
    other = F.col("original") < F.col("page_id")
    return headers.join(firsts, "digest", "left").select(
        "page_id", "url", "digest", "n_bytes",
        F.when(other, F.col("original")).alias("refers_to"),
        F.when(other, F.col("original_url")).alias("refers_to_url"),
    )


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Every page with its record type; a revisit carries no payload."""
    revisits = resolve(pages, least).where(F.col("refers_to").isNotNull())
    # stored, so that payloads are shuffled only if the revisits are too many to broadcast
    ids = stored(revisits.select("page_id", "digest", "refers_to", "refers_to_url").distinct(), "revisits")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    joined = rows.join(ids, ["page_id", "digest"], "left")
    return joined.select(
        "page_id", "url", "digest", "refers_to", "refers_to_url",
        F.when(F.col("refers_to").isNull(), F.col("html").cast("binary")).alias("payload"),
    )


def _id(page: int | None) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page}')}>"


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def record(page: int | None, url: str | None, digest: str, refers: int | None, refers_url: str | None, payload: bytes | None) -> bytes:
    """A record with fresh headers, as a gzip member of its own."""
    headers = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}"]
    if page is not None:
        headers.append(f"X-Page-Id: {page}")
    if url is not None:
        headers.append(f"WARC-Target-URI: {_clean(url)}")
    headers += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers is None:
        block = HTTP % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers)}", f"X-Refers-To-Page-Id: {refers}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_url is not None:
            headers.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    headers += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the planned records, one archive per task; returns ``name`` and ``n_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), (x.as_py() for x in batch.column(5)))
        )
        first = next(rows, None)
        if first is None:
            return
        n = 0

        def chunks():
            nonlocal n
            for row in [first]:
                n += 1
                yield record(*row)
            for row in rows:
                n += 1
                yield record(*row)

        name = write_file(folder, f"archive-{TaskContext.get().partitionId():06d}", ".warc.gz", chunks())
        yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})

    return stored(records.mapInArrow(run, "name string, n_records bigint"), "archives")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member; holds one record."""
    member, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(member.decompress(chunk))
            if not member.eof:
                break
            chunk = member.unused_data
            yield _split(b"".join(parts))
            member, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def _split(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{headers['WARC-Record-ID']}: its block is damaged")
    return headers, block


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Records of the archives: ``page_id``, ``url``, ``digest``, ``refers_to``, ``payload``.

    The payload of a response is checked against its digest; that of a revisit is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for headers, block in parse(iter(lambda: f.read(1 << 20), b"")):
                        revisit = headers["WARC-Type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: its payload is damaged")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        url = headers.get("WARC-Target-URI")
                        rows.append((
                            None if page is None else int(page), url, digest,
                            None if refers is None else int(refers), payload,
                        ))
                        size += len(block)
                        if size > 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    spark = files.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return files.select("name").repartition(parts, "name").mapInArrow(run, _READ)


_READ = "page_id bigint, url string, digest string, refers_to bigint, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write deduplicated archives to a new shared folder, read them back and resolve revisits.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``
    and ``refers_to``, one row per record.  Null html is an empty payload; a null
    id is written without an id; repeated rows are written as often as they occur;
    other columns are ignored; an empty table gives no archive.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    records = read_archives(write_archives(plan_records(pages, least), folder), folder)
    # payloads are read once; only headers go on
    headers = stored(records.select("page_id", "digest", "refers_to", F.octet_length("payload").cast("bigint").alias("n")), "warc-headers")
    answers = headers.where("refers_to is null and page_id is not null").groupBy(
        F.col("page_id").alias("refers_to"), "digest"
    ).agg(F.max("n").alias("full"))
    return headers.join(answers, ["refers_to", "digest"], "left").select(
        "page_id",
        F.coalesce("n", "full").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
    )
