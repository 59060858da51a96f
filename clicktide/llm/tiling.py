"""Benchmark decontamination by greedy string tiling.

Documents and test items meet through seeds, runs of ``TILE`` tokens that both
hold.  For each pair that shares one, the longest matches of unmarked tokens are
marked again and again, found by running Karp-Rabin hashes of falling length, so
that passages in another order are found too.  A document leaks an item if its
tiles cover enough of the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import slices
from clicktide.llm.words import BASE, NO_WORD, U, raw, windows, words

TILE = 5  # tokens of the shortest tile
COVERED = 0.6  # share of an item's tokens
BLOCK_BYTES = 8 << 20  # text of the test items that a pass over the documents takes along
SEED_BITS = 20

LEAKS = """doc_id bigint, item_id bigint, item_tokens bigint, covered bigint, coverage double,
    n_tiles bigint, longest_tile bigint"""


def _running(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``s`` tokens."""
    if len(h) < s:
        return np.empty(0, np.uint64)
    up = np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(h) - 1, U(BASE)))))
    down = np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(h) - 1, U(pow(BASE, -1, 1 << 64))))))
    total = np.concatenate(([U(0)], np.cumsum(h * up, dtype=np.uint64)))
    return (total[s:] - total[: len(total) - s]) * down[: len(h) - s + 1]


def _free_runs(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of runs of ``s`` tokens without a marked one."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[s:] == total[: len(total) - s])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two hashed token strings: (place in doc, place in item, length).

    Longest first; of equal lengths the earliest in the item, then in the document.
    An item shorter than ``least`` is matched as a whole.  What is held grows with the
    two strings, not with the number of their equal runs.
    """
    least = max(1, min(least, len(item)))
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    s = min(len(item), len(doc))
    while s >= least:
        s = _longest(doc, item, in_doc, in_item, s, least)
        if not s:
            break
        found += _marked(doc, item, in_doc, in_item, s)
        s -= 1
    return found


def _free(h: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the unmarked runs of ``s`` tokens."""
    at = _free_runs(marked, s)
    return at, _running(h, s)[at]


def _longest(doc, item, in_doc, in_item, most: int, least: int) -> int:
    """Length of the longest match of unmarked tokens, from ``least`` to ``most``; 0 without one."""
    low, high, size = least, most, 0
    # lengths that have a match are those up to the longest: halve the range
    while low <= high:
        middle = (low + high) // 2
        if np.isin(_free(item, in_item, middle)[1], _free(doc, in_doc, middle)[1]).any():
            size, low = middle, middle + 1
        else:
            high = middle - 1
    return size


def _marked(doc, item, in_doc, in_item, s: int) -> list[tuple[int, int, int]]:
    """Mark the matches of ``s`` tokens, each run of the item with the first free one of the document."""
    i, hd = _free(doc, in_doc, s)
    j, hi = _free(item, in_item, s)
    some = np.isin(hd, hi)
    order = np.argsort(hd[some], kind="stable")
    i, hd = i[some][order], hd[some][order]
    low, high = np.searchsorted(hd, hi, "left").tolist(), np.searchsorted(hd, hi, "right").tolist()
    upto: dict[int, int] = {}  # equal runs of the document that were tried; a marked one stays marked
    found = []
    for at, begin, end in zip(j.tolist(), low, high):
        if begin == end or in_item[at : at + s].any():
            continue
        k = upto.get(begin, begin)
        while k < end and in_doc[i[k] : i[k] + s].any():
            k += 1
        upto[begin] = k
        if k < end:
            in_doc[i[k] : i[k] + s] = True
            in_item[at : at + s] = True
            found.append((int(i[k]), at, s))
    return found


def _blocks(benchmark: DataFrame) -> Iterator[pa.Table]:
    """Test items in blocks of about ``BLOCK_BYTES`` of text."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")
    ).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if block.num_rows:
            yield block


class _Seeds:
    """Seeds of a block of items."""

    def __init__(self, block: pa.Table, least: int) -> None:
        text = block.column("text").combine_chunks()
        w = words(*raw(text), space=NO_WORD)
        self.ids = block.column("item_id").to_pylist()
        self.items = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in range(1, least + 1):
            h, at = windows(w, size)
            owner = w.doc[at]
            length = np.diff(w.first)[owner]
            some = (length >= least) if size == least else (length == size)
            h, owner = h[some], owner[some]
            if len(h):
                order = np.argsort(h, kind="stable")
                filled = np.zeros(1 << SEED_BITS, bool)
                filled[(h >> U(64 - SEED_BITS)).astype(np.int64)] = True
                self.sizes[size] = (h[order], owner[order], filled)

    def candidates(self, w) -> np.ndarray:
        """Distinct pairs of text and item that share a seed."""
        pairs = []
        for size, (hashes, owner, filled) in self.sizes.items():
            h, at = windows(w, size)
            maybe = np.flatnonzero(filled[(h >> U(64 - SEED_BITS)).astype(np.int64)])
            h, doc = h[maybe], w.doc[at[maybe]]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            # equal seeds of one text ask once
            key = np.unique(np.stack([doc[hit], low[hit], high[hit]], axis=1), axis=0) if len(hit) else np.empty((0, 3), int)
            n = key[:, 2] - key[:, 1]
            at_owner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(key[:, 1], n)
            pairs.append(np.stack([np.repeat(key[:, 0], n), owner[at_owner]], axis=1))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), int)


def _held_by(doc: np.ndarray, item: np.ndarray) -> float:
    """Share of the item's tokens that the document holds at all."""
    return float(np.isin(item, doc).mean())


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = TILE, covered: float = COVERED) -> DataFrame:
    """Pairs of document and test item whose tiles cover at least ``covered`` of the item.

    Tokens are runs of letters, digits and non-ASCII characters, lower-cased.
    Items travel to the documents in blocks of bounded size, one pass each;
    documents are not shuffled.  Null texts, items without tokens and null ids of
    items match nothing; equal items under several ids match each; repeated
    documents give one row per pair; other columns are ignored; empty tables give
    no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")

    def of(block: pa.Table) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = _Seeds(shared.value, least)
            for whole in batches:
                rows = []
                for batch in slices(whole, "text"):
                    w = words(*raw(batch.column(1)), space=NO_WORD)
                    for d, k in seeds.candidates(w).tolist():
                        item, doc = seeds.items[k], w.hashes[w.first[d] : w.first[d + 1]]
                        if _held_by(doc, item) < covered:
                            continue
                        found = tiles(doc, item, least)
                        n = sum(t[2] for t in found)
                        if n >= covered * len(item):
                            rows.append((batch.column(0)[d].as_py(), seeds.ids[k], len(item), n, n / len(item), len(found), max(t[2] for t in found)))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in LEAKS.split(",")])

        return plain.mapInArrow(run, LEAKS)

    parts = [of(b) for b in _blocks(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], LEAKS)
    found = reduce(DataFrame.union, parts)
    best = [F.max_by(F.struct(*[c.split()[0] for c in LEAKS.split(",")][2:]), F.struct("covered", "item_tokens", "n_tiles")).alias("best")]
    return found.groupBy("doc_id", "item_id").agg(*best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = TILE, covered: float = COVERED) -> DataFrame:
    """Documents that leak no item, all columns kept; a document without an id stays."""
    bad = leaks(docs, benchmark, least, covered).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
