"""What quality filters do together: every order of them, from the 32 subsets of five.

A document becomes a mask, a bit per filter that it fails; documents are counted
per part and mask.  From those cells a walk over all subsets in Gray-code order
toggles one filter at a time: each cell keeps the number of active filters that it
fails, and the survivors change by the cells whose number leaves or reaches zero.
A step of an order is the difference of two of the stored states.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
_ARROW = pa.schema([
    ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS),
])

Cells = dict[int, tuple[int, ...]]


def text_filters() -> dict[str, Column]:
    """Failure conditions of ``x`` (text), ``n`` (words) and ``u`` (distinct words)."""
    n, u, x = F.col("n"), F.col("u"), F.col("x")
    upper = F.length(F.regexp_replace(x, "[^A-Z]+", "")).cast("bigint")
    return {
        "A": n < 200,
        "B": 100 * u < 50 * n,
        "C": 100 * upper > 2 * F.length(x).cast("bigint"),
        "D": x.rlike(r"[#$%&*|]"),
    }


COPY = "E"  # identical to a text of a smaller id


def marked(docs: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """``doc_id, part, mask`` of every document: bit ``i`` is set if it fails filter ``i``.

    The last bit is that of ``E``: a row of the table with the same text has a
    smaller ``doc_id``.  A null text is empty, a null source is the part ``''``.
    Rows of one id with one text are no copies of each other; a row without an id
    neither fails ``E`` nor makes another fail.
    """
    filters = text_filters() if filters is None else filters
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("x"),
    )
    words = F.split(F.btrim("x", F.lit(_BLANKS)), SPACE)
    split = plain.withColumn("w", F.when(F.btrim("x", F.lit(_BLANKS)) == "", F.array().cast("array<string>")).otherwise(words))
    counted = split.select(
        "doc_id", "part", "x",
        F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("u"),
    )
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    # texts are read once; what follows sees their digests
    seen = stored(counted.select("doc_id", "part", mask.alias("m"), F.unhex(F.sha2("x", 256)).alias("digest")), "audit-marks")
    copied = (
        seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first")
    )
    fails_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return seen.join(copied, "digest", "left").select(
        "doc_id", "part", (F.col("m") + F.when(fails_copy, F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("mask"),
    )


def walk(cells: Cells, n: int) -> list[tuple[int, ...]]:
    """Sums over the cells that survive each subset of ``n`` filters, by subset mask."""
    fails = dict.fromkeys(cells, 0)
    running = [sum(c) for c in zip(*cells.values())]
    states = [tuple(running)] * (1 << n)
    active = 0
    for i in range(1, 1 << n):
        bit = i & -i  # the one that Gray code number i toggles
        active ^= bit
        change = 1 if active & bit else -1
        for mask, counts in cells.items():
            if not mask & bit:
                continue
            fails[mask] += change
            if fails[mask] == (change > 0):
                # out with the first active failure, back with the last one gone
                running = [r - change * c for r, c in zip(running, counts)]
        states[active] = tuple(running)
    return states


def steps(part: str, cells: Cells, letters: str) -> Iterator[tuple]:
    """Rows of one part: each order of ``letters``, each of its steps."""
    n = len(letters)
    states = walk(cells, n)
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    failing = {bit: sum(c[0] for m, c in cells.items() if m & bit) for bit in bits.values()}
    rows, total = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        active = 0
        for step, letter in enumerate(order, 1):
            bit = bits[letter]
            before, active = states[active], active | bit
            after = states[active]
            gone = [a - b for a, b in zip(before, after)]
            total[letter] += gone[0]
            alone = cells.get(bit, (0,))[0]
            rows.append((part, "".join(order), step, after[0], gone[0], failing[bit] - gone[0], alone, gone[1], gone[2], letter))
    for *row, letter in rows:
        yield (*row, total[letter])


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """Per part and order of the filters, what each step keeps, removes and costs.

    Columns are those of ``SCHEMA``.  ``docs`` needs ``doc_id, source, text``,
    ``labels`` needs ``doc_id, quality, toxic``; other columns are ignored.  A label
    counts if any row of the id has it; a document without one is neither good nor
    toxic.  Repeated rows count as often as they occur.  An empty table gives no
    rows, and a filter that fails nothing has zeros.

    Each part is worked off by itself, from at most two to the number of filters
    rows.  Filters are named by one letter each; their orders are all listed, so
    there should be few of them.
    """
    letters = "".join(filters or text_filters()) + COPY
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
             F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    )
    cells = (
        marked(docs, filters).join(known, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("good"),
             F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic"))
    )
    # at most one entry per mask
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = steps(part, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in found}, letters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW,
                )

    return parts.mapInArrow(run, SCHEMA)
