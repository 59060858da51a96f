"""Connected components of a link table, in Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import stored

SMALL = 500_000  # links, 8 MB, that one task may finish


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable, of every node of ``a``-``b`` links.

    Each round hooks a component to its smallest neighbour, shortens the paths and
    contracts the links, which at least halves the components that have any.  Once
    at most ``small`` links are left, one task finishes them.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    comp = links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while links.count() > small:
        parent = links.groupBy("hi").agg(F.min("lo").alias("up"))
        above = parent.select(F.col("hi").alias("up"), F.col("up").alias("higher"))
        parent = stored(parent.join(above, "up", "left").select("hi", F.coalesce("higher", "up").alias("up")), "parents")
        comp = stored(_renamed(comp, parent), "components")
        hi = parent.select("hi", F.col("up").alias("x"))
        lo = parent.select(F.col("hi").alias("lo"), F.col("up").alias("y"))
        moved = links.join(hi, "hi").join(lo, "lo", "left").select("x", F.coalesce("y", "lo").alias("y")).where("x <> y")
        links = stored(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
    return _renamed(comp, stored(links.repartition(1).mapInArrow(_roots, "hi bigint, up bigint"), "parents"))


def _renamed(comp: DataFrame, parent: DataFrame) -> DataFrame:
    named = comp.join(parent.withColumnRenamed("hi", "comp"), "comp", "left")
    return named.select("node", F.coalesce("up", "comp").alias("comp"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node reachable from each node of all links."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    links = np.concatenate(parts, axis=1)
    nodes, place = np.unique(links, return_inverse=True)
    hi, lo = place.reshape(links.shape)
    root = np.arange(len(nodes))
    while True:
        a, b = root[hi], root[lo]
        apart = a != b
        if not apart.any():
            break
        hi, lo, a, b = hi[apart], lo[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["hi", "up"])
