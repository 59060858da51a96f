"""Trees and proofs against a plain recursion."""

import zlib
from hashlib import sha256

import pytest
from conftest import STRANGE
from pyspark.sql import functions as F

from clicktide.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, position string, node string, path string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The last node, and for each leaf what stands beside it on every level."""
    beside = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        groups = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, slot = groups[i // fanout], i % fanout
            beside[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = i // fanout
        nodes = [h("".join(g)) for g in groups]
    return nodes[0], beside


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    made = {s: climb([leaf(r) for r in ordered[s]], fanout) for s in names}
    root, above = climb([made[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above):
        for r, beside in zip(ordered[s], made[s][1]):
            path = beside + up
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], lower(r[4])))
            for left, right in path:
                node = h(left + node + right)
            proof = h("".join(a + b for a, b in path))
            out.append((r[0], leaf(r), made[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def check(spark, rows, fanout=16):
    got = merkle.verified(frame(spark, rows).repartition(4), fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, fanout)


def make(counts):
    return [(i * 7 % 1009, s, "en", i, f"Text {i} of {s}") for s, n in counts.items() for i in range(n)]


@pytest.mark.parametrize("counts", [
    {"a": 1}, {"a": 16}, {"a": 17}, {None: 1, "": 2, "é": 33, "z": 257},
])
def test_sixteen_children(spark, counts):
    check(spark, make(counts))


def test_many_levels_and_sources(spark):
    check(spark, make({"hot": 70, None: 1, **{f"s{i}": 1 + i % 4 for i in range(11)}}), fanout=3)


def test_strange_documents(spark):
    rows = [(d, s, None, len(t or ""), t) for (d, t), s in zip(STRANGE, ["a", None, "b", "a", ""] * 3)]
    rows += [(5, "a", "en", None, "ÄB C"), (5, "a", "en", None, "ÄB C"), (5, "a", "en", 1, None), (None, None, None, None, None)]
    check(spark, rows, fanout=4)


def test_empty_table(spark):
    assert merkle.verified(frame(spark, make({"a": 2})).where("false")).count() == 0


def test_a_proof_reveals_what_was_changed(spark):
    df = frame(spark, make({"a": 40, "b": 3}))
    got = merkle.manifest(df, tampered={"n_chars": F.when(F.col("doc_id") == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    root = merkle.folded(F.coalesce("twin", "leaf"), F.col("path"))
    bad = got.where(root != F.col("root")).select("doc_id").distinct().collect()
    assert [r.doc_id for r in bad] == [7]


def test_the_driver_gets_no_paths_and_samples_by_the_rows(spark, monkeypatch):
    plans, ranges = [], []
    kept, ordered = merkle.stored, merkle.stored_in_order

    def stored(df, name):
        if name in ("merkle-paths", "merkle-ends"):
            plans.append(df)
        return kept(df, name)

    def stored_in_order(df, *order, **more):
        ranges.append((order[0], more.get("partitions")))
        return ordered(df, *order, **more)

    monkeypatch.setattr(merkle, "stored", stored)
    monkeypatch.setattr(merkle, "stored_in_order", stored_in_order)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rows = make({"a": 40, "b": 1, None: 3})
    made = merkle.verified(frame(spark, rows), 4)
    for df in (*plans, made):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert len(plans) == 5
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranges == [("source", min(3, most)), ("source", 1)]
    assert sorted(map(tuple, made.collect()), key=repr) == plain(rows, 4)
