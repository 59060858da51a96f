"""Removal of repeated substrings by suffix order.

Every ``size``-byte string holds an anchor, a run of ``ANCHOR`` bytes whose hash is
the smallest there, so equal strings hold equal anchors at equal places.  Documents
meet through anchors alone:

1. For each anchor hash and its surroundings (all strings of ``size`` bytes that hold
   it), a task sends one entry for each few MB that it reads.  Surroundings that a smaller
   document has too are repeated as a whole.
2. Where one anchor has several surroundings, their first documents send the bytes.
   Shards of these are sorted by suffix, and neighbours whose common prefix reaches
   ``size`` are one string.  An anchor with very many surroundings sends the hashes
   of its strings instead, which are summed up like anchors.
3. Each task collects what was found for the documents it holds.

Entries travel packed, one row per task and bucket, sorted and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import open_folder, slices, stored, texts
from clicktide.llm.induced import common_prefixes, suffix_order
from clicktide.llm.words import BASE, BYTE_VALUE, U, mix, powers, raw
from clicktide.session import scratch_dir

SIZE = 50
ANCHOR = 24
BUCKET_BYTES = 4 << 20  # text behind a bucket of entries
SHARDS = 8  # buckets of the second step for each one of the first
MANY = 20_000  # surroundings of one anchor that are still sorted together
SLICE = 1 << 19  # bytes of text whose anchors are sought at once
ENTRIES = 500_000  # anchors that a part holds before it packs them
HELD = 8 << 20  # bytes that a part holds before it packs them
LAST = np.iinfo(np.int64).max  # stands for a missing id, after all others


# --- packed entries ---------------------------------------------------------------


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first ascending, stored as differences."""
    parts = [len(arrays[0]).to_bytes(8, "little")]
    for i, a in enumerate(arrays):
        if i == 0:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty((0, 0), np.uint8)
        parts.append(np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw_ = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw_[:8], "little"), 8, []
    for i, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw_, np.uint8, n * size, at).reshape(size, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=a.dtype) if i == 0 else a)
        at += n * size
    return out


def _bucket_edges(key: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of the ascending keys in each bucket that has some; a bucket is a range of keys."""
    if not len(key):
        return
    number = ((key >> U(32)) * U(buckets)) >> U(32)
    begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    yield from zip(number[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(key)])


def _by_bucket(part: int, kind: int, buckets: int, key: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, part, kind, data) of entries."""
    order = np.argsort(key, kind="stable")
    key, more = key[order], [m[order] for m in more]
    for b, low, high in _bucket_edges(key, buckets):
        yield b, part, kind, pack_arrays(key[low:high], *(m[low:high] for m in more))


PACKED = "bucket bigint, part bigint, kind int, data binary"
_PACKED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


# --- anchors ----------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    done, out = 1, x
    while 2 * done <= width:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    return pick(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1])


class Anchors:
    """Anchors of the texts in ``body``: place, text, hash, and the hash of their surroundings."""

    def __init__(self, body: np.ndarray, at: np.ndarray, size: int, anchor: int) -> None:
        self.size, n = size, len(body)
        self.at = self.doc = self.low = self.high = np.empty(0, np.int64)
        self.hash = self.around = np.empty(0, np.uint64)
        if n < size:
            self.total, self.down = np.zeros(n + 1, np.uint64), powers(n + 1)[1]
            return
        up, self.down = powers(n + 1)
        self.total = np.concatenate(([U(0)], np.cumsum(BYTE_VALUE[body] * up[:n], dtype=np.uint64)))
        h = mix((self.total[anchor:] - self.total[: n + 1 - anchor]) * self.down[: n + 1 - anchor])
        width = size - anchor + 1
        # windows that cross from one text to the next have no smallest hash
        least = _sliding(h, width, np.minimum)  # by start of the window
        valid = np.zeros(n - size + 1, dtype=bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= size:
                valid[a : b - size + 1] = True
        least[~valid] = 0
        # an anchor is the smallest of some window: the largest of these minima
        padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        best = _sliding(padded, width, np.maximum)
        del least, padded, valid
        self.at = np.flatnonzero((best == h) & (best > 0))
        # spread anew: the smallest hashes lie close together; 48 bits bring together all that
        # may be equal, which the hash of the surroundings and the bytes decide
        self.hash = mix(h[self.at] + U(1)) & ~U(0xFFFF)
        self.doc = np.searchsorted(at, self.at, "right") - 1
        self.low = np.maximum(self.at - (size - anchor), at[self.doc])
        self.high = np.minimum(self.at + size, at[self.doc + 1])
        whole = (self.total[self.high] - self.total[self.low]) * self.down[self.low]
        shape = ((self.at - self.low) * 1024 + (self.high - self.low)).astype(np.uint64)
        self.around = mix(mix(whole) + shape * U(BASE))

    def strings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the strings of ``size`` bytes around an anchor."""
        start = np.arange(self.low[i], self.high[i] - self.size + 1)
        return start, mix((self.total[start + self.size] - self.total[start]) * self.down[start] + U(5))


def _together(h: np.ndarray, around: np.ndarray) -> np.ndarray:
    return mix(h * U(BASE) + around)


def _first_docs(order: np.ndarray, new: np.ndarray, doc: np.ndarray, pick) -> np.ndarray:
    return pick.reduceat(doc[order], np.flatnonzero(new))


# --- steps ------------------------------------------------------------------------


def _numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with the number of their part and their row in it, stored; other columns go as ``keep0`` and so on."""
    plain = texts(docs, *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(row, row + n))], names=[*plain_names, "part", "row"]
            )
            row += n

    plain_names = plain.columns
    kinds = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    return stored(plain.mapInArrow(run, f"{kinds}, part bigint, row bigint"), "numbered")


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


class _Entries:
    """Entries of one part, until they are packed: one for each anchor and surroundings."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, h: np.ndarray, around: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((h, around, doc))
        self.held += len(h)

    def rows(self, part: int, buckets: int) -> Iterator[tuple]:
        h, around, doc = (np.concatenate(c) for c in zip(*self.parts))
        key = _together(h, around)
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        one, first = order[new], _first_docs(order, new, doc, np.minimum)
        several = _first_docs(order, new, doc, np.maximum) > first
        return _by_bucket(part, 0, buckets, h[one], around[one], first, several.astype(np.uint8))


def _anchor_entries(docs: DataFrame, size: int, anchor: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[int, _Entries] = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                body, at = raw(batch.column("text"))
                a = Anchors(body, at, size, anchor)
                doc = _ids(batch.column("doc_id"))[a.doc]
                part = batch.column("part").to_numpy()[a.doc]
                for p in np.unique(part).tolist():
                    some = part == p
                    entries.setdefault(p, _Entries()).add(a.hash[some], a.around[some], doc[some])
                for p in [p for p, e in entries.items() if e.held > ENTRIES]:
                    yield _rows(list(entries.pop(p).rows(p, buckets)))
        for p, e in entries.items():
            yield _rows(list(e.rows(p, buckets)))

    return docs.mapInArrow(run, PACKED)


# What a part learns of its surroundings: they are repeated; or their bytes or their strings are asked for.
REPEATED, BYTES, STRINGS = 1, 2, 3


def _resolve_anchors(entries: DataFrame, many: int) -> DataFrame:
    """For each part, the surroundings whose first document is another, or that are one of several."""

    def resolve(table: pa.Table) -> pa.Table:
        got = [unpack_arrays(d.as_py(), "<u8", "<u8", "<i8", "u1") for d in table.column("data")]
        n = [len(g[0]) for g in got]
        part = np.repeat(table.column("part").to_numpy(), n)
        h, around, first, several = (np.concatenate(c) for c in zip(*got))
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order[1:]] != h[order[:-1]])
        group = np.cumsum(new) - 1
        # an anchor that one document has says nothing
        starts = np.flatnonzero(new)
        low, high = np.minimum.reduceat(first[order], starts), np.maximum.reduceat(first[order], starts)
        more = (low < high) | np.maximum.reduceat(several[order], starts).astype(bool)
        order = order[more[group]]
        if not len(order):
            return pa.table({"part": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        h, around, first, several, part = h[order], around[order], first[order], several[order], part[order]
        order = np.lexsort((around, h))
        new_h = np.append(True, h[order[1:]] != h[order[:-1]])
        new = new_h | np.append(True, around[order[1:]] != around[order[:-1]])
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
        first_of = np.minimum.reduceat(first[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        asked = np.where(kinds > many, STRINGS, np.where(kinds > 1, BYTES, REPEATED)).astype(np.uint8)
        # alone and first: nothing to be told
        some = (kinds > 1) | (first_of < first[order]) | (several[order] > 0)
        key, part = _together(h, around)[order][some], part[order][some]
        first_of, asked = first_of[some], asked[some]
        parts, data = [], []
        by_part = np.lexsort((key, part))
        cut = np.flatnonzero(np.append(True, part[by_part[1:]] != part[by_part[:-1]])) if len(part) else []
        for a, b in zip(cut, [*cut[1:], len(by_part)]):
            rows = by_part[a:b]
            parts.append(int(part[rows[0]]))
            data.append(pack_arrays(key[rows], first_of[rows], asked[rows]))
        return pa.table({"part": pa.array(parts, pa.int64()), "data": pa.array(data, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(resolve, "part bigint, data binary")


def _by_part(found: DataFrame, name: str) -> str:
    """Store rows in a folder for each part."""
    path = scratch_dir(found.sparkSession, name)
    found.repartition("part").write.partitionBy("part").parquet(path)
    return path


def _of_part(folder: str, part: int) -> list[bytes]:
    fs, root = open_folder(folder)
    path = f"{root}/part={part}"
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type == FileType.NotFound:
        return []
    table = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["data"])
    return [d.as_py() for d in table.column("data")]


@lru_cache(maxsize=1)
def _told(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of surroundings in ascending order, their first documents, what is asked."""
    got = [unpack_arrays(d, "<u8", "<i8", "u1") for d in _of_part(folder, part)]
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    key, first, asked = (np.concatenate(c) for c in zip(*got))
    order = np.argsort(key, kind="stable")
    return key[order], first[order], asked[order]


def _spans(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    order = np.lexsort((low, row))
    return pack_arrays(row[order].astype(np.int64), low[order].astype(np.int64), high[order].astype(np.int64))


# rows of the second step
SPANS, BYTES_OF, STRINGS_OF = 0, 1, 2


class _Asked:
    """What one part sends in the second step, until it is packed."""

    def __init__(self) -> None:
        self.spans: list[tuple] = []
        self.bytes: list[tuple] = []
        self.strings: list[tuple] = []
        self.size = 0

    def rows(self, part: int, buckets: int) -> Iterator[tuple]:
        if self.spans:
            # a bucket of the part's own, past which they go unchanged
            yield -1 - part, part, SPANS, _spans(*_united(*(np.concatenate(c) for c in zip(*self.spans))))
        if self.bytes:
            yield from _packed_bytes(part, buckets, *(np.concatenate(c) for c in zip(*self.bytes)))
        if self.strings:
            yield from _by_bucket(part, STRINGS_OF, buckets, *(np.concatenate(c) for c in zip(*self.strings)))


def _pieces(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    n = high - low
    return body[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _ask(docs: DataFrame, told: str, size: int, anchor: int, buckets: int) -> DataFrame:
    """Spans that are repeated as a whole, and what first documents send of the rest."""

    def look(batch: pa.RecordBatch, asked_of: dict[int, _Asked]) -> None:
        body, at = raw(batch.column("text"))
        a = Anchors(body, at, size, anchor)
        ids, rows = _ids(batch.column("doc_id")), batch.column("row").to_numpy()
        parts = batch.column("part").to_numpy()
        key = _together(a.hash, a.around)
        for p in np.unique(parts).tolist():
            keys, first, asked = _told(told, p)
            if not len(keys):
                continue
            mine = np.flatnonzero(parts[a.doc] == p)
            place = np.minimum(np.searchsorted(keys, key[mine]), len(keys) - 1)
            hit = keys[place] == key[mine]
            mine, place = mine[hit], place[hit]
            doc = a.doc[mine]
            base, out = at[doc], asked_of.setdefault(p, _Asked())
            again = first[place] < ids[doc]
            s = mine[again]
            out.spans.append((rows[doc[again]], a.low[s] - base[again], a.high[s] - base[again]))
            wants = ~again & (asked[place] == BYTES)
            s, d = mine[wants], doc[wants]
            n = a.high[s] - a.low[s]
            out.bytes.append((a.hash[s], ids[d], rows[d], a.low[s] - base[wants], n, _pieces(body, a.low[s], a.high[s])))
            out.size += int(n.sum()) + 24 * len(mine)
            wants = ~again & (asked[place] == STRINGS)
            got = [a.strings(i) for i in mine[wants].tolist()]
            if got:
                n = [len(g[0]) for g in got]
                d = np.repeat(doc[wants], n)
                out.strings.append((np.concatenate([g[1] for g in got]), ids[d], rows[d], np.concatenate([g[0] for g in got]) - at[d]))
                out.size += 32 * len(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_of: dict[int, _Asked] = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                look(batch, asked_of)
                for p in [p for p, x in asked_of.items() if x.size > HELD]:
                    yield _rows(list(asked_of.pop(p).rows(p, buckets)))
        for p, x in asked_of.items():
            yield _rows(list(x.rows(p, buckets)))

    return docs.mapInArrow(run, PACKED)


def _packed_bytes(part: int, buckets: int, h, ids, rows, low, length, text) -> Iterator[tuple]:
    order = np.argsort(h, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    h, ids, rows, low, length = h[order], ids[order], rows[order], low[order], length[order]
    pack = zstandard.ZstdCompressor(level=1)
    for b, first, end in _bucket_edges(h, buckets):
        k = slice(first, end)
        head = pack_arrays(h[k], ids[k], rows[k], low[k], length[k])
        own = _pieces(text, begin[k], begin[k] + length[k])
        yield b, part, BYTES_OF, len(head).to_bytes(8, "little") + head + pack.compress(own.tobytes())


def _sorted_shard(data: list[bytes], part: np.ndarray, size: int) -> tuple:
    """Part, row, start and end of the strings that a smaller document holds too."""
    heads, bodies = [], []
    for d in data:
        n = int.from_bytes(d[:8], "little")
        heads.append(unpack_arrays(d[8 : 8 + n], "<u8", "<i8", "<i8", "<i8", "<i8"))
        bodies.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(d[8 + n :]), np.uint8))
    n = [len(h[0]) for h in heads]
    part = np.repeat(part, n)
    _, ids, rows, low, length = (np.concatenate(c) for c in zip(*heads))
    body = np.concatenate(bodies)
    # a zero ends each piece
    ends = np.cumsum(length)
    text = np.insert(body.astype(np.int16) + np.int16(1), ends, 0)
    begin = (ends - length + np.arange(len(length))).astype(np.int32)
    piece = np.repeat(np.arange(len(length), dtype=np.int32), length + 1)
    inside = np.arange(len(text), dtype=np.int32) - begin[piece]
    string = inside + size <= length[piece]
    order = suffix_order(text)
    order = order[string[order]]
    del string
    common = common_prefixes(text, order, size)
    new = common < size
    if not len(order):
        return part[:0], rows[:0], low[:0], low[:0]
    doc = ids[piece[order]]
    first = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[first < doc]
    p = piece[hit]
    start = low[p] + inside[hit]
    return part[p], rows[p], start, start + size


def _resolve_rest(asked: DataFrame, size: int) -> DataFrame:
    """Spans to remove, by part: those known already, and strings that a smaller document holds."""

    def resolve(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["part", "data"])
        kind, part = table.column("kind").to_numpy(), table.column("part").to_numpy()
        data = [d.as_py() for d in table.column("data")]
        found = []
        if (some := np.flatnonzero(kind == BYTES_OF)).size:
            found.append(_sorted_shard([data[i] for i in some], part[some], size))
        if (some := np.flatnonzero(kind == STRINGS_OF)).size:
            got = [unpack_arrays(data[i], "<u8", "<i8", "<i8", "<i8") for i in some]
            owner = np.repeat(part[some], [len(g[0]) for g in got])
            h, ids, rows, start = (np.concatenate(c) for c in zip(*got))
            order = np.argsort(h, kind="stable")
            new = np.append(True, h[order[1:]] != h[order[:-1]])
            hit = order[np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1] < ids[order]]
            found.append((owner[hit], rows[hit], start[hit], start[hit] + size))
        owner, rows, low, high = (np.concatenate(c) for c in zip(*found))
        parts = np.unique(owner)
        spans = [_spans(*_united(rows[s], low[s], high[s])) for s in (owner == p for p in parts)]
        return pa.table({"part": pa.array(parts, pa.int64()), "data": pa.array(spans, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(resolve, "part bigint, data binary")


def _united(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a row as one; spans of a row have one length or are sorted."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    # the farthest end so far, within a row: rows are lifted apart
    lift = np.cumsum(np.append(0, row[1:] != row[:-1])) * (int(high.max()) + 1)
    far = np.maximum.accumulate(high + lift)
    new = np.append(True, low[1:] + lift[1:] > far[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], low[new], far[last] - lift[last]


@lru_cache(maxsize=1)
def _removed(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [unpack_arrays(d, "<i8", "<i8", "<i8") for d in _of_part(folder, part)]
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return _united(*(np.concatenate(c) for c in zip(*got)))


def spans_of(docs: DataFrame, size: int, many: int, *keep: str) -> tuple[DataFrame, str]:
    """Numbered documents, and the folder with the spans to remove, by part."""
    anchor = min(ANCHOR, max(1, size // 2))
    whole = _numbered(docs, *keep)
    numbered = whole.select("doc_id", "text", "part", "row")
    total = numbered.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    told = _by_part(_resolve_anchors(_anchor_entries(numbered, size, anchor, buckets), many), "surroundings")
    return whole, _by_part(_resolve_rest(_ask(numbered, told, size, anchor, SHARDS * buckets), size), "spans")


def remove_repeats(
    docs: DataFrame, size: int = SIZE, many: int = MANY, keep: tuple[str, ...] = (), as_text: bool = False
) -> DataFrame:
    """``doc_id``, ``kept`` (the bytes left) and ``spans`` (of the input) of every document.

    The columns named in ``keep`` come along as ``keep0``, ``keep1`` and so on.
    With ``as_text`` what is left is a string, without characters that were cut in two.

    A byte goes if it is covered by a string of ``size`` bytes of the UTF-8 text
    that also starts in a document with a smaller id, in the input.  Null texts
    are empty.  Rows of one id remove nothing from each other; a missing id comes
    after all others.  Other columns are ignored; an empty table gives no rows.
    """
    numbered, folder = spans_of(docs, size, many, *keep)
    more = [f"keep{i}" for i in range(len(keep))]
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                body, at = raw(batch.column("text"))
                kept, lists = [], []
                for i, (p, r) in enumerate(zip(batch.column("part").to_pylist(), batch.column("row").to_pylist())):
                    row, low, high = _removed(folder, p)
                    a, b = np.searchsorted(row, [r, r + 1])
                    text, last, parts = body[at[i] : at[i + 1]], 0, []
                    own = list(zip(low[a:b].tolist(), high[a:b].tolist()))
                    for begin, end in own:
                        parts.append(text[last:begin])
                        last = end
                    parts.append(text[last:])
                    left = b"".join(x.tobytes() for x in parts)
                    kept.append(left.decode(errors="ignore") if as_text else left)
                    lists.append([{"begin": x, "end": y} for x, y in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(lists, kind), *(batch.column(c) for c in more)],
                    names=["doc_id", "kept", "spans", *more],
                )

    kinds = "".join(f", {c} {t}" for c, t in numbered.dtypes if c in more)
    left = "string" if as_text else "binary"
    return numbered.mapInArrow(run, f"doc_id bigint, kept {left}, spans array<struct<begin:bigint,end:bigint>>{kinds}")


def digests(docs: DataFrame, size: int = SIZE, many: int = MANY) -> DataFrame:
    """Sizes and hash of what ``remove_repeats`` leaves of every document."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(docs, size, many).select(
        "doc_id", (F.octet_length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
