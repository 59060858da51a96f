"""Mixing against a plain loop, and its promises on strange tables."""

import hashlib
import re

import pytest
from conftest import SMALL, STRANGE
from pyspark.sql import functions as F

from clicktide.llm import mixing
from clicktide.llm.common import table
from clicktide.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, source string, size string, copies string, target string, position string"


def plain_targets(sizes):
    """Shares by weight, stopped one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        share = {s: weight[s] * left / open_ for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]} | stopped
        if over == stopped:
            return {s: float(3 * sizes[s]) if s in stopped else share[s] for s in order}
        stopped = over


def plain(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t) for d, t, s in rows]
    sizes = {}
    for _, s, n, _ in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = plain_targets(sizes), []
    for s in sizes:
        seed = "mix/" + ("n" if s is None else f"s{s}")
        at = int(hashlib.md5(seed.encode()).hexdigest()[:6], 16)
        step = int(goal[s] / sizes[s] * 2**24 + 0.5) if sizes[s] else 0
        for d, _, n, _ in sorted((r for r in sized if r[1] == s), key=lambda r: (r[2], r[0] is not None, r[0] or 0)):
            out.append((d, n, sizes[s], round(goal[s], 6), ((at + step) // 2**24 - at // 2**24) * n))
            at += step
    return sorted(out, key=repr)


def found(df):
    cols = ("doc_id", "size", "source_size", "target", "taken")
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.mix(df).select(*cols).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "x", "x", "x") for d, t, s in rows], SCHEMA)


def rows_of(sources):
    out = []
    for i, (name, count, words) in enumerate(sources):
        out += [(1000 * i + k, "w " * (words + k % 5), name) for k in range(count)]
    return out


@pytest.mark.parametrize("sources", [
    [("a", 40, 3), ("b", 30, 9), (None, 20, 1)],
    [("a", 1, 1), ("b", 1, 400), ("c", 1, 400), ("d", 2, 1)],  # the first weighs most and stops
    [("only", 7, 3)],
    [("é", 9, 2), ("z", 9, 2), ("Z", 9, 2), ("", 9, 2), (None, 9, 2)],
    [("hot", 600, 1), ("x", 3, 2)],
])
def test_equals_a_plain_loop(spark, sources):
    rows = rows_of(sources)
    assert found(frame(spark, rows).repartition(5)) == plain(rows)


def test_strange_documents(spark):
    rows = [(d, t, s) for (d, t), s in zip(STRANGE, [None, "a", "a", "b", None] * 3)]
    assert found(frame(spark, rows)) == plain(rows)


def test_empty_table_and_no_words(spark):
    assert found(frame(spark, [(1, None, "a")]).where("false")) == []
    assert found(frame(spark, [(1, None, "a"), (2, " \n", None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = [(1, "one two three", "a")] * 6 + [(1, "four", "a"), (2, "five six", "b"), (None, "x", "b"), (None, "x", "b")]
    got = mixing.mix(frame(spark, rows))
    assert got.count() == len(rows)
    emitted = mixing.emitted(frame(spark, rows), got)
    assert emitted.count() == got.agg(F.sum("copies")).first()[0]


def test_close_to_the_targets_whatever_the_partitions(spark):
    docs = table(spark, SMALL, "documents")
    one, many = mixing.mix(docs), mixing.mix(docs.repartition(13))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    longest = {r[0]: r[1] for r in one.groupBy("source").agg(F.max("size")).collect()}
    for r in one.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= longest[r.source]
    assert one.where("taken > 3 * size or copies > 3").count() == 0
    sums = one.agg(F.sum("size").alias("size")).first().size
    assert sum(r[0] for r in one.select("source", "target").distinct().select("target").collect()) == pytest.approx(sums)


def test_emitted_words_are_those_taken(spark):
    docs = table(spark, SMALL, "documents")
    mixed = mixing.mix(docs)
    words = mixing.emitted(docs, mixed).agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == mixed.agg(F.sum("taken")).first()[0]


def test_stays_in_the_jvm(spark):
    plan = QUERIES["op11_source_mix"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas", "ExternalRDD"))
