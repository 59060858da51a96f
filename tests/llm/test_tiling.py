import random

import numpy as np
from conftest import STRANGE

from clicktide.llm import tiling
from clicktide.llm.common import table


def plain_tiles(doc, item, least):
    """Greedy tiling by its definition."""
    least = max(1, min(least, len(item)))
    in_doc, in_item, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, j, i)
        if best is None:
            return found
        n, j, i = best
        in_doc[i : i + n] = [True] * n
        in_item[j : j + n] = [True] * n
        found.append((i, j, n))


def test_tiles_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        doc = np.array([rng.randrange(6) for _ in range(rng.randrange(40))], dtype=np.uint64)
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 15))], dtype=np.uint64)
        least = rng.choice([1, 2, 3, 5])
        assert tiling.tiles(doc, item, least) == plain_tiles(doc.tolist(), item.tolist(), least)


def test_repeated_tokens_take_no_more_room_than_the_text():
    """A million equal tokens against an item of 400: their equal runs are 400 million pairs."""
    import tracemalloc

    doc = np.full(1_000_000, 7, dtype=np.uint64)
    doc[500_000] = 8
    item = np.concatenate((np.full(300, 7), [9], np.full(99, 7))).astype(np.uint64)
    tracemalloc.start()
    found = tiling.tiles(doc, item, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 300), (300, 301, 99)]
    assert peak < 120 * len(doc)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_and_partial_passages(spark, docs):
    w = ITEM.split()
    rows = [
        (1, "x y " + ITEM.upper() + "! z"), (2, " ".join([*w[12:], "and", *w[6:12], *w[:6]])), (3, " ".join(w[:8])),
        (4, " ".join(reversed(w))), (5, "tiny thing here"), (6, None), (7, "Tiny, thing."), (8, ITEM), (8, ITEM), (None, ITEM), (9, ""),
    ]
    bench = spark.createDataFrame([(10, ITEM), (11, "tiny thing"), (12, None), (None, ITEM), (13, ""), (10, ITEM), (14, "absent words only")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.covered, r.n_tiles) for r in tiling.leaks(docs(rows), bench).collect())
    assert got == [(0, 10, 20, 1), (1, 10, 20, 1), (2, 10, 20, 3), (5, 11, 2, 1), (7, 11, 2, 1), (8, 10, 20, 1)]
    kept = {r.doc_id for r in tiling.decontaminate(docs(rows), bench).collect()}
    assert kept == {3, 4, 6, 9, None}
    assert tiling.leaks(docs(rows), bench.where("false")).count() == 0
    assert tiling.leaks(docs(rows).where("false"), bench).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    df, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    one = sorted(map(tuple, tiling.leaks(df, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, tiling.leaks(df, bench).collect())) == one and one


def test_query_against_plain_tiling(spark):
    import re

    d = "/root/testdata/sf0.001"
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs = [(r.doc_id, cut(r.text or "")) for r in table(spark, d, "documents").collect()]
    items = [(r.item_id, cut(r.text)) for r in table(spark, d, "benchmark").collect()]
    want = set()
    for doc, t in docs:
        have = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for item, x in items:
            if any(tuple(x[i : i + 5]) in have for i in range(len(x) - 4)):
                n = sum(m[2] for m in plain_tiles(t, x, 5))
                if n >= 0.6 * len(x):
                    want.add((doc, item, n))
    got = {(r.doc_id, r.item_id, r.covered) for r in tiling.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).collect()}
    assert got == want


def test_strange(strange, spark):
    bench = spark.createDataFrame([(1, STRANGE[6][1])], "item_id bigint, text string")
    assert {r.doc_id for r in tiling.leaks(strange, bench).collect()} == {7, 8}
