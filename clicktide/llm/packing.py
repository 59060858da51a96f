"""Packing by multiway differencing (Karmarkar-Karp).

Documents become ids; a task cuts full windows off and gathers what is left over.
Once a group of leftovers fills ``GROUP`` windows, it is divided among them: the
two partial partitions with the largest imbalance are merged, fullest window to
emptiest, until one partition is left.  If a window then exceeds its capacity,
the group is divided anew over one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import texts
from clicktide.llm.tokens import byte_bpe, encoded

WINDOW = 2048
END = 1
GROUP = 64  # windows that are balanced together
SPARE = 12  # ids a window of a group is left to keep free, for the imbalance
GRAIN = 32  # a few documents of a group are cut this fine, to level the windows
GRAINS = 0.04  # their share of the ids

SCHEMA = """doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,
    sequence_id bigint, offset bigint"""
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(",")])


def divide(lengths: list[int], k: int) -> list[list[int]]:
    """Indexes of ``lengths`` in ``k`` windows of nearly equal sums."""
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [(i,), *[()] * (k - 1)]))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        slots = [p + q for p, q in zip(x, reversed(y))]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, [slots[j] for j in order.tolist()]))
        made += 1
    return [list(s) for s in heap[0][3]] if heap else []


def balance(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``window``; their number rises while one exceeds it."""
    k = max(1, -(-sum(lengths) // window))
    while True:
        parts = divide(lengths, k)
        if all(sum(lengths[i] for i in p) <= window for p in parts):
            return [p for p in parts if p]
        k += 1


class _Packer:
    """Pieces of one task; ``sequence`` numbers its windows."""

    def __init__(self, window: int, sequence: int) -> None:
        self.window, self.sequence = window, sequence
        self.rest: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0
        self.goal = GROUP * (window - min(SPARE, window // 100))
        self.out: list[tuple] = []

    def place(self, doc, start: int, ids: bytes, total: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.window
        for start in range(0, full, self.window):
            self.place(doc, start, ids[4 * start : 4 * (start + self.window)], total, 0)
            self.sequence += 1
        if full < total:
            self.rest.append((doc, full, ids[4 * full :], total))
            self.held += total - full
            if self.held >= self.goal:
                self.close(whole=False)

    def close(self, whole: bool) -> None:
        """Balance what is held; unless ``whole``, ids beyond the goal stay for the next group."""
        items, left = self.rest, []
        if not whole and self.held > self.goal:
            doc, start, ids, total = items[-1]
            keep = len(ids) // 4 - (self.held - self.goal)
            items = items[:-1] + ([(doc, start, ids[: 4 * keep], total)] if keep else [])
            left = [(doc, start + keep, ids[4 * keep :], total)]
        size = sum(len(x[2]) for x in items) // 4
        fine, pieces = GRAINS * size, []
        for doc, start, ids, total in reversed(items):
            step = min(GRAIN, self.window) if fine > 0 else max(1, self.window // 2)
            fine -= len(ids) // 4
            for i in range(0, len(ids), 4 * step):
                pieces.append((doc, start + i // 4, ids[i : i + 4 * step], total))
        lengths = [len(p[2]) // 4 for p in pieces]
        for part in balance(lengths, self.window):
            offset = 0
            # neighbouring pieces of a document that met again are one piece
            for doc, start, ids, total in _joined(sorted((pieces[i] for i in part), key=lambda p: (p[0] is None, p[0] or 0, p[1]))):
                self.place(doc, start, ids, total, offset)
                offset += len(ids) // 4
            self.sequence += 1
        self.rest, self.held = left, sum(len(x[2]) for x in left) // 4


def _joined(pieces: list[tuple]) -> Iterator[tuple]:
    last = None
    for doc, start, ids, total in pieces:
        if last and last[0] == doc and last[3] == total and last[1] + len(last[2]) // 4 == start:
            last = (doc, last[1], last[2] + ids, total)
            continue
        if last:
            yield last
        last = (doc, start, ids, total)
    if last:
        yield last


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` ids.

    One row per piece: its document, its place in it, its length and crc32, the
    ids of the document, and the window (``sequence_id``) with the offset there.
    A document is the ids of its text, then ``end``.  Windows are padded by the
    reader, so they hold no padding.

    A task packs what it reads, without a shuffle, and holds one group of
    leftovers at a time; each task may leave one window partly empty.  A null or
    empty text is its end id alone.  Repeated documents are packed as often as
    they occur, a null ``doc_id`` stays null, other columns are ignored, and an
    empty table gives no rows.
    """
    path = tokenizer or byte_bpe()
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(window, TaskContext.get().partitionId() << 33)

        def taken() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for doc, ids in encoded(batches, path):
            packer.add(doc, ids + last)
            if len(packer.out) > 20_000:
                yield taken()
        if packer.held:
            packer.close(whole=True)
        if packer.out:
            yield taken()

    return texts(docs).mapInArrow(run, SCHEMA)


def packed_lengths(pieces: DataFrame) -> DataFrame:
    """Ids in each window."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"))
