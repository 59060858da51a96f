"""Gap sessions against a plain loop, whatever the partitions."""

import random
from datetime import timedelta

import pytest
from fixtures import T0, action, actions

from clicktide.operators import gaps
from clicktide.operators.ranged import PART, in_order


def plain(rows, gap):
    """(user, time, number) of (user, seconds), in order."""
    out, last = [], {}
    for user, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if user not in last:
            number = 1
        else:
            before, number = last[user]
            number += (before is None) != (t is None) or (t is not None and t - before > gap)
        last[user] = t, number
        out.append((user, t, number))
    return sorted(out, key=repr)


def found(spark, rows, gap, tie=None):
    log = [(u, None if t is None else T0 + timedelta(seconds=t)) for u, t in rows]
    df = spark.createDataFrame(log, "user_id bigint, action_time timestamp")
    got = gaps.number_sessions(df.repartition(3), gap).collect()
    seconds = lambda t: None if t is None else (t - T0).total_seconds()
    return sorted(((r.user_id, seconds(r.action_time), r.session_no) for r in got), key=repr)


@pytest.fixture(params=[1, 7, 40])
def ranges(spark, request):
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_user_over_many_partitions(spark, ranges):
    rnd = random.Random(3)
    rows = [(1, float(rnd.randrange(100_000))) for _ in range(500)]
    rows += [(rnd.randrange(2, 90), float(rnd.randrange(100_000))) for _ in range(1000)]
    assert found(spark, rows, 600) == plain(rows, 600)
    log = spark.createDataFrame([(u, T0 + timedelta(seconds=t)) for u, t in rows], "user_id bigint, action_time timestamp")
    sizes = [r["count"] for r in in_order(log, "user_id", "action_time").groupBy(PART).count().collect()]
    assert max(sizes) <= max(2.5 * len(rows) / ranges, 60)


def test_edges(spark, ranges):
    rows = [(1, 0.0), (1, 600.0), (1, 1200.5), (1, 1200.5), (2, 0.0), (None, 5.0), (None, 900.0), (3, None), (3, None), (3, 1.0)]
    assert found(spark, rows, 600) == plain(rows, 600)
    # one instant, many rows, in several partitions
    assert {n for _, _, n in found(spark, [(5, 1.0)] * 300, 0)} == {1}


def test_empty_log(spark):
    assert found(spark, [(1, 1.0)], 1) and gaps.number_sessions(
        spark.createDataFrame([], "user_id bigint, action_time timestamp")).count() == 0


def test_actions_get_new_session_ids(spark):
    log = actions(spark, action("x", 0, user=7), action("x", 10, user=7), action("x", 99999, user=7), action("y", 0, user=8))
    got = gaps.cut_at_gaps(log)
    assert got.columns == log.columns
    assert sorted(r.session_id for r in got.collect()) == ["7-1", "7-1", "7-2", "8-1"]
