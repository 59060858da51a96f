import random

import numpy as np
import pytest
from conftest import STRANGE
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from clicktide.llm import substrings
from clicktide.llm.common import table
from clicktide.llm.induced import common_prefixes, suffix_order
from clicktide.llm.queries import QUERIES


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order_and_common_prefixes(t):
    order = suffix_order(np.array(t, dtype=np.int64)).tolist()
    assert order == sorted(range(len(t)), key=lambda i: t[i:])
    common = common_prefixes(np.array(t, dtype=np.int64), np.array(order, dtype=np.int64), 9)
    for k in range(1, len(order)):
        a, b = t[order[k - 1] :], t[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(n, 9)


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    assert result(QUERIES["op6_substring_dedup"](spark, d)) == brute.substrings(docs)


@pytest.mark.parametrize("many", [substrings.MANY, 1])
def test_overlaps_edges_and_runs(docs, many):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(400))
    rows = []
    for i in range(60):
        a, b = rng.randrange(300), rng.randrange(40, 120)
        noise = "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(80)))
        rows.append((i, noise + base[a : a + b] + noise[::-1] + base[a + 30 : a + 30 + b] + "=" * rng.randrange(120)))
    rows += [(100, base), (101, base[:49]), (102, base[:50]), (103, base[1:51]), (104, base), (90, base[200:] + base[:200])]
    rng.shuffle(rows)
    assert result(substrings.digests(docs(rows).repartition(5), many=many)) == brute.substrings(rows)


@pytest.mark.parametrize("many", [substrings.MANY, 1])
def test_strange(strange, many):
    rows = [s for s in STRANGE if s[0]]
    got = result(substrings.digests(strange, many=many))
    assert {d: v for d, v in got.items() if d} == brute.substrings(rows)
    assert got[None][1] == 0


def test_repeated_ids_and_empty_table(docs):
    text = "the very same sentence, long enough to be found again and again"
    df = docs([(1, text), (1, text), (2, text), (None, text)])
    assert sorted((r.doc_id or 99, r.n_removed) for r in substrings.digests(df).collect()) == [(1, 0), (1, 0), (2, len(text)), (99, len(text))]
    assert substrings.digests(df.where("false")).count() == 0


def test_texts_and_spans_that_are_left(docs):
    rows = [(1, "x" + "0123456789" * 6), (2, "ab" + "0123456789" * 6 + "c")]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(rows)).collect()}
    assert bytes(got[2].kept) == b"abc" and [tuple(s) for s in got[2].spans] == [(2, 62)] and got[1].spans == []
