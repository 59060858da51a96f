"""Sources mixed to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's
target divided by its size.  The prefix sum of these expectations within the
source, plus one random offset, crosses an integer once per copy to emit.  As
documents stand in the order of their size, the words taken miss the target by
less than one longest document.  Everything is in integers, so neither the number
of partitions nor a repeated task changes a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import stored
from clicktide.operators.ranged import positions, stored_in_order

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and targets in sizes of their source
SEED = "mix"
BITS = 24  # of an expectation behind the point: exact for 2**37 documents of a source

_BLANKS = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    # a word with the blanks after it becomes one character
    return F.length(F.regexp_replace(begun, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources by code point, null last, take ``weights`` in turn and share the sum of
    all sizes.  A target stops at ``most`` times the size; what is over is shared
    anew among the others until none is above.  A round is one aggregate; each but the last stops
    another source.
    """
    order = F.asc_nulls_last("source")
    ranked = positions(stored_in_order(sizes, order, name="mix-sources"))
    turn = F.get(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.col("position") % len(weights)).cast("int"))
    cap = F.lit(int(most)).cast("bigint") * F.col("source_size")
    weighed = stored(ranked.select("source", "source_size", turn.alias("weight"), cap.alias("cap")), "mix-weights")
    share, stopped = None, -1
    while True:
        over = F.lit(False) if share is None else share > F.col("cap")
        found = weighed.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0))).alias("left"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("over"),
        ).first()
        if found["over"] == stopped or not found["weight"]:
            break
        stopped = found["over"]
        share = F.col("weight") * F.lit(found["left"]).cast("bigint") / F.lit(found["weight"]).cast("double")
    target = F.lit(0.0) if share is None else F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(share)
    return weighed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source, print`` of every document.

    ``size`` is the number of words, ``target`` that of the document's source,
    ``copies`` how often the mix holds the document, at most ``most``, and ``taken``
    its words there.  ``print`` (a hash of the text) tells rows of one id apart for
    :func:`emitted`.

    A null text has size 0 and is taken with 0 words, like an empty one; a null
    source is a source of its own, the last; rows with a null or repeated
    ``doc_id`` are documents of their own; other columns are ignored; an empty
    table gives no rows.  A source without a word has target 0.
    """
    text = F.col("text").cast("string")
    sized = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"), F.xxhash64(text).alias("print"),
    ), "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    unit = 1 << BITS
    expected = F.coalesce(F.floor(F.try_divide("target", "source_size") * unit + 0.5), F.lit(0).cast("bigint"))
    label = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5(label.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")
    rated = stored(goal.select(
        F.col("source").alias("goal_source"), "source_size", "target", expected.alias("expected"), offset.alias("start"),
    ), "mix-goals")
    ranked = positions(stored_in_order(sized, "source", "size", "doc_id", "print", name="mix-order"), "source")
    with_goal = ranked.join(rated, F.col("source").eqNullSafe(F.col("goal_source")))
    # the prefix sum of equal expectations
    upto = F.col("start") + F.col("position") * F.col("expected")
    copies = F.shiftright(upto + F.col("expected"), BITS) - F.shiftright(upto, BITS)
    return with_goal.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"), "source", "print",
    )


def emitted(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: ``doc_id, source, text, copy``, a row per copy, numbered from 0.

    Rows that agree in id, source and text are one text with the copies of all.
    """
    keys = ["doc_id", "source", "print"]
    wanted = mixed.groupBy(*keys).agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        text.alias("text"), F.xxhash64(text).alias("print"),
    ).dropDuplicates(keys)
    same = [rows[k].eqNullSafe(wanted[k]) for k in keys]
    return rows.join(wanted, same).select(
        rows["doc_id"], rows["source"], "text",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"),
    )
