import random
from collections import Counter

import pytest
from fixtures import action, actions, tuples

from clicktide.operators import pageflow as p
from clicktide.operators.ranged import PART, in_order


def test_steps_and_rates(spark):
    log = actions(
        spark,
        # 1 2 2 3: repeated page; the pair 2_2 is outside the flow
        action("a", 0, page=1), action("a", 1, page=2), action("a", 2, page=2), action("a", 3, page=3),
        # start page without a next step
        action("b", 0, page=1),
        # 1 2 1 2: the same step twice
        action("c", 0, page=1), action("c", 1, page=2), action("c", 2, page=1), action("c", 3, page=2),
    )
    assert tuples(p.page_split_counts(log, (1, 2, 3, 4))) == [("1_2", 3), ("2_3", 1)]
    assert p.start_page_visits(log, (1, 2, 3)).first()[0] == 4
    rates = tuples(p.page_convert_rate(log, (1, 2, 3, 4, 5)))
    # a step after one that never happens has rate 0
    assert rates == [(1, "1_2", 3, 0.75), (2, "2_3", 1, 0.33), (3, "3_4", 0, 0.0), (4, "4_5", 0, 0.0)]
    texts = [r[0] for r in tuples(p.convert_rate_text(p.page_convert_rate(log, (1, 2, 3))))]
    assert texts == ["1_2=0.75", "2_3=0.33"]


def test_no_start_visits(spark):
    log = actions(spark, action("a", 0, page=2), action("a", 1, page=3), action("a", 2, page=4))
    assert [r[3] for r in tuples(p.page_convert_rate(log, (9, 2, 3, 4)))] == [0.0, 0.0, 0.0]


def test_more_steps_than_visits(spark):
    # 3_4 more often than 2_3
    log = actions(
        spark, action("a", 0, page=2), action("a", 1, page=3), action("a", 2, page=4),
        action("b", 0, page=3), action("b", 1, page=4),
    )
    assert [r[3] for r in tuples(p.page_convert_rate(log, (2, 3, 4)))] == [1.0, 2.0]


@pytest.fixture(params=[1, 2, 8, 40])
def ranges(spark, request):
    """The log in so many range partitions, none of them merged."""
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_sessions_cut_by_ranges(spark, ranges):
    """One session holds a third of all rows and spans many partitions."""
    rnd = random.Random(7)
    rows = [action("hot", rnd.randrange(40000) / 4, page=rnd.randrange(6)) for _ in range(700)]
    rows += [action(f"s{rnd.randrange(200)}", rnd.randrange(4000), page=rnd.randrange(6)) for _ in range(1400)]
    want, starts = Counter(), 0
    per_session = {}
    for r in rows:
        per_session.setdefault(r[2], []).append((r[4], r[3]))
    for visits in per_session.values():
        pages = [page for _, page in sorted(visits)]
        want.update(f"{a}_{b}" for a, b in zip(pages, pages[1:]))
    flow = (0, 1, 2, 3, 4, 5)
    expected = sorted((s, want[s]) for s in p.flow_steps(flow) if want[s])
    log = actions(spark, *rows)
    assert tuples(p.page_split_counts(log, flow)) == expected
    assert p.previous_pages(log).count() == len(rows)
    firsts = p.previous_pages(log).where("prev_page is null").count()
    assert firsts == len(per_session)


def test_actions_without_a_page(spark, ranges):
    """They are no step and no visit, and they part their neighbours."""
    log = actions(
        spark, action("a", 0, page=1), action("a", 1, page=None), action("a", 2, page=2),
        action("b", 0, page=1), action("b", 700, page=2), action("c", 0, page=None), action("c", 1, page=2),
    )
    assert tuples(p.page_split_counts(log, (1, 2))) == [("1_2", 1)]
    assert tuples(p.page_convert_rate(log, (1, 2))) == [(1, "1_2", 1, 0.5)]
    assert p.previous_pages(log).count() == 7


def test_a_hot_session_is_split(spark, ranges):
    """A session with a third of the log, half of it in one instant: no partition holds much more than its share."""
    rows = [action("hot", 30 if i % 2 else i / 10, page=i % 4) for i in range(600)]
    rows += [action(f"s{i % 300}", i % 600, page=i % 4) for i in range(1200)]
    log = actions(spark, *rows)
    sizes = [r["count"] for r in in_order(log.select(*p.ORDER), *p.ORDER).groupBy(PART).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2.5 * len(rows) / ranges
    by_session = {}
    for r in rows:
        by_session.setdefault(r[2], []).append((r[4], r[3]))
    want = Counter()
    for visits in by_session.values():
        pages = [page for _, page in sorted(visits)]
        want.update(zip(pages, pages[1:]))
    got = Counter((r.prev_page, r.page_id) for r in p.previous_pages(log).where("prev_page is not null").collect())
    assert got == want


def test_no_actions(spark):
    log = actions(spark, action("a", 0, page=1)).where("false")
    assert tuples(p.page_split_counts(log, (1, 2))) == []
    assert tuples(p.page_convert_rate(log, (1, 2))) == [(1, "1_2", 0, 0.0)]
    assert tuples(p.previous_pages(log)) == []
