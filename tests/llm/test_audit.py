"""The filter audit against filters applied one after the other."""

import re
from itertools import permutations

from conftest import STRANGE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktide.llm import audit

SCHEMA = "doc_id bigint, text string, source string, n string, u string, x string, m string, part string, mask string"


def failures(rows):
    """Letters that each row fails."""
    out = []
    for d, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def plain(rows, labels):
    fails = failures(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for x in "ABCDE":
            total = sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(x) + 1].append(total)
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, s, *"xxxxxx") for d, t, s in rows], SCHEMA)
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")


def check(spark, rows, labels):
    got = audit.audit(*frames(spark, rows, labels)).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == plain(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_strange_documents(spark):
    sources = ["a", None, "", "b", "a"] * 3
    rows = [(d, t, s) for (d, t), s in zip(STRANGE, sources)]
    rows += [(20, "X#" * 5, "a"), (21, "X#" * 5, "b"), (21, "X#" * 5, "b"), (None, "X#" * 5, "b"), (0, None, "c"), (22, "word " * 300, "a")]
    labels = [(1, 1, 0), (2, 0, 1), (21, None, 1), (21, 1, None), (20, 1, 1), (99, 1, 1), (None, 1, 1), (7, 1, 0)]
    check(spark, rows, labels)


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(i, "the same" if i % 3 else f"text {i}", "hot" if i % 2 else "cold") for i in range(300)]
    check(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 4)])


def test_empty_tables(spark):
    docs, labels = frames(spark, [(1, "x", "a")], [(1, 1, 1)])
    assert audit.audit(docs.where("false"), labels).count() == 0
    assert audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_filters_of_your_own(spark):
    docs, labels = frames(spark, [(1, "x", "a"), (2, "xyz", "a"), (3, "xyz", "a")], [(1, 1, 1)])
    got = audit.audit(docs, labels, {"L": F.length("x") > 2}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in got} == {
        ("LE", 1): (1, 2, 0), ("LE", 2): (1, 0, 1), ("EL", 1): (2, 1, 0), ("EL", 2): (1, 1, 1)}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1))
def test_the_walk_gives_the_sum_of_every_subset(cells):
    states = audit.walk(cells, 5)
    for subset in range(32):
        alive = [c for m, c in cells.items() if not m & subset]
        assert states[subset] == (sum(c[0] for c in alive), sum(c[1] for c in alive))
