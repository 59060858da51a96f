import random
import time

from conftest import STRANGE

import brute
from clicktide.llm import near
from clicktide.llm.common import table
from clicktide.llm.graph import components
from clicktide.llm.queries import NEAR_OP, QUERIES


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    assert result(QUERIES["op7_near_duplicates"](spark, d)) == brute.near(docs, 3, 85)


def test_strange(strange):
    rows = near.near_duplicates(strange, NEAR_OP).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id} == brute.near([s for s in STRANGE if s[0]], 3, 85)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_copies(docs):
    """A chain of edits, in which far ends are linked only through others, among copies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        if i % 3 == 0:
            words = list(words)
            words[rng.randrange(120)] = f"new{i}"
        rows.append((1000 - i, " ".join(words)))
    base = [f"b{i}" for i in range(150)]
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"e{rng.randrange(10_000)}"
        rows.append((2000 + i, " ".join(w)))
    assert result(near.near_duplicates(docs(rows), NEAR_OP)) == brute.near(rows, 3, 85)
    assert result(near.near_duplicates(docs(rows))) == brute.near(rows, 5, 80)
    # every key that two sets share is a crowd, so that all links between components rest on rare shingles
    assert result(near.near_duplicates(docs(rows), NEAR_OP, crowd=1)) == brute.near(rows, 3, 85)


def test_many_texts_of_one_template(docs):
    """5,000 texts that are alike by 0.7 share most of their keys and are not linked; a near copy of every hundredth is."""
    rng = random.Random(6)
    base = [f"t{i}" for i in range(200)]
    rows, want = [], {}
    for i in range(5000):
        slots = rng.sample(range(4, 190, 4), 7)
        w = list(base)
        for k, at in enumerate(slots[:6]):
            w[at] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
        want[i] = (198, i)
        if i % 100 == 0:
            w[slots[6]] = f"copy{i}"
            rows.append((10_000 + i, " ".join(w)))
            want[10_000 + i] = (198, i)
    started = time.monotonic()
    assert result(near.near_duplicates(docs(rows), NEAR_OP)) == want
    assert time.monotonic() - started < 240


def test_repeated_rows_and_empty_table(docs):
    df = docs([(1, "some words that are the same"), (1, "some words that are the same"), (2, "Some words that ARE the same")])
    assert [(r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(df, NEAR_OP).orderBy("doc_id").collect()] == [
        (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near.near_duplicates(df.where("false"), NEAR_OP).count() == 0


def test_every_pair_within_the_limit_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    for how in (near.Near(), NEAR_OP, near.Near(values=20, errors=2)):
        a = rng.integers(0, 2**32, (300, how.values)).astype(np.uint32)
        b = a.copy()
        for row in b:
            row[rng.choice(how.values, how.limit, replace=False)] ^= 1
        assert (how.keys(a) == how.keys(b)).any(axis=1).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: root[n] for e in edges if e[0] != e[1] for n in e}
    for small in (0, 60, 10**6):  # by rounds alone, by both, in one task
        assert {r.node: r.comp for r in components(df, small).collect()} == want
    assert components(df.where("false")).count() == 0


def test_sketches_differ_in_no_more_places_than_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (5, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64))))
        x, y = near.parities(a, np.zeros(len(a), int), 1), near.parities(b, np.zeros(len(b), int), 1)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_one_id_with_several_texts(docs):
    """Each text of an id finds its own copies; classes are named by their smallest id."""
    rng = random.Random(4)
    a, b, c, d = ([f"{k}{rng.randrange(10**6)}" for _ in range(200)] for k in "abcd")
    rows = [(5, a), (5, b), (5, c), (7, [*a[:-1], "x"]), (8, [*b[:-1], "x"]), (9, [*c[:-1], "x"]), (3, c), (4, []), (4, d), (6, [*d[:-1], "x"])]
    got = near.near_duplicates(docs([(i, " ".join(t)) for i, t in rows]), NEAR_OP).collect()
    want = [(3, 3), (4, 4), (4, 4), (5, 3), (5, 5), (5, 5), (6, 4), (7, 5), (8, 5), (9, 3)]
    assert sorted((r.doc_id, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_counts_of_shingles_are_few_rows(spark):
    """A task hands on a row for each block of cells, not one for each cell."""
    import numpy as np
    import pyarrow as pa

    from clicktide.llm.words import raw, shingles, words

    texts = [" ".join(f"w{i}x{k}" for k in range(100)) for i in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert near._task_counts(df, NEAR_OP).count() <= 4 * (1 << near.CELL_BITS) // near.BLOCK
    h, _ = shingles(words(*raw(pa.array(texts))), 3)
    assert (near._shingle_counts(df, NEAR_OP) == np.bincount(near._cells(h), minlength=1 << near.CELL_BITS)).all()
