"""Merkle tree over documents, a tree per source and one over the sources.

Leaves get positions in their source from range partitions.  A level is made by a
slot pivot: conditional aggregates spread the children of a parent into one column
per slot; the columns together are hashed, and without a child's own column they
are its siblings.  Proofs go down the tree: a parent hands what stands left and
right of a child, and all it was handed itself, to that child, so that documents
meet only the row of their own run.

The driver holds no nodes and no paths: Spark takes a string for 20 bytes and an
array for one element, so it would broadcast paths a hundred times its limit; they
are joined by sorting.  Bounds of range partitions are sampled by the rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.llm.common import bucket_of, stored
from clicktide.operators.ranged import PLACE, positions, runs, same_run, stored_in_order

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"
RANGE_ROWS = 1 << 15  # rows of leaves in a range partition


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def _slots(fanout: int) -> list[str]:
    return [f"c{i}" for i in range(fanout)]


def _up(fanout: int) -> Column:
    return F.floor(F.col("position") / fanout).cast("bigint")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (``tree, position, members, node``), lowest first.

    A level has the parents of the trees that still had several nodes: ``tree,
    position, members`` (on this level), ``node`` and the children ``c0, c1, ...``.
    """
    out, below = [], nodes
    most = nodes.agg(F.max("members")).first()[0] or 0
    while most > 1:
        slot = F.pmod(F.col("position"), F.lit(fanout))
        spread = (
            below.where("members > 1").groupBy("tree", _up(fanout).alias("up"))
            .agg(F.max(F.ceil(F.col("members") / fanout)).cast("bigint").alias("members"),
                 *[F.max(F.when(slot == i, F.col("node"))).alias(c) for i, c in enumerate(_slots(fanout))])
        )
        # a short run lacks its last columns
        below = stored(spread.select(
            "tree", F.col("up").alias("position"), "members", digest(F.concat_ws("", *_slots(fanout))).alias("node"),
            *_slots(fanout),
        ), "merkle-level")
        out.append(below)
        most = -(-most // fanout)
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """``tree, height, node`` of the last node of every tree, ``height`` levels above its nodes."""
    found = None
    for height, level in enumerate([nodes, *above]):
        last = level.where("members = 1").select("tree", F.lit(height).alias("height"), "node")
        found = last if found is None else found.unionByName(last)
    return found


def _beside(slot: Column, fanout: int) -> Column:
    """What stands left and right of a slot; columns that a short run lacks are null."""
    children = F.array(*_slots(fanout))
    return F.struct(
        F.concat_ws("", F.slice(children, F.lit(1), slot)).alias("left"),
        F.concat_ws("", F.slice(children, slot + 2, F.lit(fanout))).alias("right"),
    )


def handed_down(above: list[DataFrame], ends: DataFrame, fanout: int = FANOUT) -> DataFrame | None:
    """The lowest level of ``above``, with ``path`` (nearest first) and ``subroot`` of each row.

    ``ends`` (``tree, height, path, subroot``) says what stands beside the whole tree,
    which has its last node on level ``height``.
    """
    rows = None
    for height, level in reversed([*enumerate(above, 1)]):
        given = ends.where(F.col("height") == height).select(
            "tree", F.lit(0).cast("bigint").alias("position"), "path", "subroot")
        if rows is not None:
            slot = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot")
            child = F.get(F.array(*_slots(fanout)), F.col("slot"))
            down = rows.select("*", slot).where(child.isNotNull()).select(
                "tree", (F.col("position") * fanout + F.col("slot")).alias("position"),
                F.concat(F.array(_beside(F.col("slot"), fanout)), F.col("path")).alias("path"), "subroot",
            )
            given = given.unionByName(down)
        rows = stored(
            level.join(given.hint("merge"), ["tree", "position"]).select(level["*"], "path", "subroot"), "merkle-paths")
    return rows


def _ranges(spark: SparkSession, rows: int) -> int:
    """Number of range partitions for so many rows, at most that of shuffles."""
    return max(1, min(-(-rows // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every document, with ``twin``.

    A leaf hashes ``fields``.  Leaves of a source stand by ``doc_id``, null first,
    rows of one id by their leaf; every ``fanout`` of them become their hash until
    one is left, the ``subroot``; subroots by source, null first, give ``root`` in the
    same way.  ``path`` lists what stands left and right of the document's node on
    every level, lowest first.  ``twin`` is the leaf of the row with the columns in
    ``tampered`` put in place, null where they change nothing.

    Repeated rows are leaves of their own, a null value is told from every text,
    other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    honest = [F.col(c) for c in fields]
    changed = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    changes = F.lit(False)
    for name, value in (tampered or {}).items():
        changes = changes | ~value.eqNullSafe(F.col(name))
    hashed = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf(honest).alias("leaf"), F.when(changes, changed).alias("twin"),
    ), "merkle-leaves")
    counted = hashed.agg(F.count(F.lit(1)), F.approx_count_distinct("source")).first()
    of_rows, of_sources = (_ranges(spark, n) for n in counted)
    rows = stored_in_order(hashed, "source", "doc_id", "leaf", name="merkle-order", partitions=of_rows)

    sources = stored_in_order(
        rows.select("source").distinct(), "source", name="merkle-sources", partitions=of_sources)
    trees = stored(positions(sources).select(
        F.col("source").alias("of"), F.col("position").alias("tree"), F.col("members").alias("sources"),
    ), "merkle-trees")
    found = runs(rows, "source").join(trees, F.col("run_group").eqNullSafe(F.col("of"))).drop("of", "sources")
    nodes = stored(rows.join(found, same_run("source")).select(
        "tree", (F.col(PLACE) + F.col("run_shift")).alias("position"), "members", "doc_id", F.col("leaf").alias("node"), "twin",
    ), "merkle-nodes")

    above = levels(nodes, fanout)
    # the tree of the subroots; its trees' numbers are its positions
    subroots = stored(tops(nodes, above).join(trees, "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"), F.col("sources").alias("members"),
        "node", "height",
    ), "merkle-subroots")
    over = levels(subroots, fanout)
    top = tops(subroots, over).select("node").first()
    root = F.lit(top[0] if top else None).cast("string")
    nothing = F.array().cast(PATH)
    if over:
        highest = handed_down(over, spark.range(1).select(
            F.col("id").alias("tree"), F.lit(len(over)).alias("height"), nothing.alias("path"), root.alias("subroot"),
        ), fanout)
        ends = _placed(subroots, highest, fanout).select(
            F.col("position").alias("tree"), "height", "path", F.col("node").alias("subroot"))
    else:
        ends = subroots.select(
            F.col("position").alias("tree"), "height", nothing.alias("path"), F.col("node").alias("subroot"))
    ends = stored(ends, "merkle-ends")

    columns = ["doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", "twin"]
    out = nodes.where("members = 1").join(ends.where("height = 0").hint("merge"), "tree").select(*columns)
    lowest = handed_down(above, ends, fanout)
    if lowest is not None:
        several = _placed(nodes.where("members > 1"), lowest, fanout, "subroot")
        out = out.unionByName(several.select(*columns))
    return out


def _placed(nodes: DataFrame, parents: DataFrame, fanout: int, *more: str) -> DataFrame:
    """``nodes`` with the path from themselves up, by the rows of their parents."""
    up = parents.select(
        "tree", F.col("position").alias("up"), F.col("path").alias("upper"), *more, *_slots(fanout))
    slot = F.pmod(F.col("position"), F.lit(fanout)).cast("int")
    path = F.concat(F.array(_beside(slot, fanout)), F.col("upper"))
    return nodes.withColumn("up", _up(fanout)).join(up.hint("merge"), ["tree", "up"]).select(
        *nodes.columns, *more, path.alias("path"))


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` and its path give."""
    return F.aggregate(path, node, lambda below, x: digest(F.concat(x["left"], below, x["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def lowered(text: Column) -> Column:
    """``A-Z`` alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def verified(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest checked against documents of which every fifth was tampered with.

    Where 5 divides the crc32 of the id, the text is lower-cased; the root folded
    from that leaf is compared with the true one.  A document without an id is not
    tampered with.
    """
    text = F.col("text").cast("string")
    hit = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    made = manifest(docs, tampered={"text": F.when(hit, lowered(text)).otherwise(text)}, fanout=fanout)
    root = folded(F.coalesce("twin", "leaf"), F.col("path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
